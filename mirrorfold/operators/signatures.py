"""MinHash signatures, their bands, and what they estimate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorfold.functions import scalars as S
from mirrorfold.functions import texts
from mirrorfold.plans.checkpoints import cut

EMPTY = S.PRIME  # the value of every slot of an empty set


def by_slots(grams: DataFrame, slots: int) -> DataFrame:
    """(file_id, gram) -> (file_id, slot, value): a partial minimum a task before the shuffle."""
    hashed = grams.select("file_id", S.h28(F.col("gram")).alias("h"))
    mins = hashed.groupBy("file_id").agg(*(F.min(S.affine(F.col("h"), k)).alias(f"s{k}") for k in range(slots)))
    return mins.select("file_id", F.posexplode(F.array(*(f"s{k}" for k in range(slots)))).alias("slot", "value")).select("file_id", F.col("slot").cast("long").alias("slot"), "value")


def full_signatures(files_: DataFrame, slots: int = S.SLOTS) -> DataFrame:
    """file_id, signature of `slots` values over word 5-grams, from the text in Arrow batches."""
    k = np.arange(slots, dtype=np.uint64)
    a, b, prime, bits = k * np.uint64(2654435) + np.uint64(97), k * np.uint64(40503) + np.uint64(11), np.uint64(S.PRIME), np.uint64(31)

    def one(text: bytes | None) -> np.ndarray:
        least, h = np.full(slots, prime), texts.h28(set(texts.runs(text)))
        for at in range(0, len(h), 512):  # blocks that stay in a core's cache
            x = np.multiply.outer(a, h[at : at + 512])
            x += b[:, None]
            x = (x & prime) + (x >> bits)  # below twice the prime, which is 2**31 - 1
            least = np.minimum(least, np.minimum(x, x - prime).min(axis=1))  # below the prime the difference wraps around
        return least

    def make(ids: list, rows: list) -> pa.RecordBatch:
        flat = np.concatenate([one(t) for t in rows]) if rows else np.empty(0)
        signature = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * slots, pa.array(flat.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), signature], ["file_id", "signature"])

    return texts.each_text(files_, "file_id", "file_id long, signature array<long>", make)


def of_files(files_: DataFrame, slots: int) -> DataFrame:
    """file_id, signature of the files that have grams, worked out once; the texts of one id are one file's."""
    made = full_signatures(files_, slots).where(F.array_min("signature") < EMPTY)
    return cut(made.groupBy("file_id").agg(F.array(*(F.min(F.col("signature")[k]).cast("int") for k in range(slots))).alias("signature")))


def slot_rows(signatures: DataFrame) -> DataFrame:
    """(file_id, signature) -> (file_id, slot, value)."""
    return signatures.select("file_id", F.posexplode("signature").alias("slot", "value")).select("file_id", F.col("slot").cast("long").alias("slot"), F.col("value").cast("long").alias("value"))


def bands(signatures: DataFrame, slots: int, rows: int) -> DataFrame:
    """(file_id, signature) -> (file_id, band, key), the key as a band's values: a row a band, none a slot."""
    keys = F.array(*(F.slice("signature", at + 1, rows) for at in range(0, slots, rows)))
    return signatures.select("file_id", F.posexplode(keys).alias("band", "key"))


def estimates(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, share of equal slots; either file's signature is joined as one row."""
    a, b = signatures.select(F.col("file_id").alias("left"), F.col("signature").alias("x")), signatures.select(F.col("file_id").alias("right"), F.col("signature").alias("y"))
    return pairs.join(a, "left").join(b, "right").select("left", "right", F.round(S.signature_estimate(F.col("x"), F.col("y")), 6).alias("estimate"))

"""Lempel-Ziv phrase fingerprints of texts, compared by their minimum hashes.

A text's bytes are parsed into phrases, each the shortest run that the text's dictionary lacks. The set of
phrases is hashed and its least hashes are the fingerprint: texts that compress alike share phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import need, table, width
from mirrorfold.llm.shingles import mixed
from mirrorfold.llm.tokens import arrow, rows

KEPT = 128  # least hashes in a fingerprint


class Phrases:
    """A text's dictionary: phrases numbered from 1, each its prefix's number and one byte more; 0 is the empty one.

    A step looks up one number, whatever the phrase's length, so that the work is linear in the text.
    """

    def __init__(self):
        self.next: dict[int, int] = {}
        self.hashes = [0xCBF29CE484222325]
        self.open = 0

    def copy(self) -> Phrases:
        other = Phrases()
        other.next, other.hashes, other.open = self.next.copy(), self.hashes.copy(), self.open
        return other

    def parse(self, data: bytes) -> Phrases:
        """Go on with `data`: each phrase that is new ends, and the next begins; the last may stay open."""
        at, known, hashes, find = self.open, self.next, self.hashes, self.next.get
        for byte in data:
            step = at << 8 | byte
            longer = find(step)
            if longer is None:
                known[step] = len(hashes)
                hashes.append((hashes[at] ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF)
                at = 0
            else:
                at = longer
        self.open = at
        return self


def least(phrases: Phrases) -> np.ndarray:
    hashes = (mixed(np.array(phrases.hashes[1:], np.uint64)) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 2 * KEPT:
        hashes = np.partition(hashes, 2 * KEPT)[: 2 * KEPT]  # room for a few equal ones
    return np.unique(hashes)[:KEPT]


def text_of(kept: np.ndarray) -> str:
    return kept.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the union's least hashes that both texts have; 1 for two empty texts."""
    union = np.union1d(a, b)[:KEPT]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def fingerprint(text: str) -> np.ndarray:
    return least(Phrases().parse(text.encode()))


def edited(text: str, other: str) -> str:
    """The last half of the text's code points gives way to as many from the start of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def both_prints(text: str, new: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and its edited form; the `kept` code points that they share are parsed once."""
    own = Phrases().parse(text[:kept].encode())
    other = own.copy()
    return least(own.parse(text[kept:].encode())), least(other.parse(new[kept:].encode()))


def chained(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, id, doc_id, text) in partitions by descending doc_id; each ends with the row that follows it (ahead = 1).

    Ties go by text; null ids come last. The first document of each part is found by its id alone and sent
    to the part before it, so the texts move once.
    """

    spark = docs.sparkSession
    parts = width(spark)
    rows_ = need(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    cuts = rows_.select("id").where("doc_id IS NOT NULL").approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    bounds = np.array(sorted(set(cuts or [])), dtype=np.float64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.float64), side="right"))

    placed = rows_.withColumn("part", part_of("id"))
    tops = rows_.select("id").withColumn("part", part_of("id")).groupBy("part").agg(F.max("id").alias("id")).collect()  # a row a part
    order = sorted((r["part"], r["id"]) for r in tops)
    before = {ident: order[k - 1][0] for k, (_, ident) in enumerate(order)}
    if not order:
        return placed.select("part", F.lit(0).alias("ahead"), "id", "doc_id", "text")
    firsts = spark.createDataFrame([(i, p) for i, p in before.items()], "id long, to int")
    heads = rows_.join(F.broadcast(firsts), "id").groupBy("to", "id").agg(F.min(F.struct("text")).alias("t"), F.max("doc_id").alias("doc_id"))  # a row a part
    heads = heads.select(F.col("to").alias("part"), F.lit(1).alias("ahead"), "id", "doc_id", F.col("t.text").alias("text"))
    all_ = placed.select("part", F.lit(0).alias("ahead"), "id", "doc_id", "text").unionByName(heads)
    return all_.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("ahead", F.desc("id"), "text")


def prints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, its edited text's, and how near they and the next document's are.

    The next document has the next lower doc_id (after the last, the first; alone, itself). Null texts
    count as empty, null ids come after all others, repeated rows follow each other. Two empty texts are
    alike in full, an empty and another not at all. No rows: no result rows.
    """
    import pyarrow as pa

    names = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def make(batches):
        def out():
            held = None
            for ahead, doc_id, text in rows(batches, "ahead", "doc_id", "text"):
                if held is not None:
                    held_id, held_text = held
                    new = edited(held_text, text)
                    mine, other = both_prints(held_text, new, len(held_text) - len(held_text) // 2)
                    waiting = held_id, len(held_text), hashlib.sha256(new.encode()).hexdigest(), text_of(mine), text_of(other), likeness(mine, other)
                    if before is not None:
                        yield *before, likeness(last, mine)
                    before, last = waiting, mine
                    if ahead:
                        yield *before, likeness(last, fingerprint(text))
                        return
                else:
                    before = None
                held = doc_id, text

        yield from arrow(out(), pa.schema(names), 1024)

    return chained(docs).select("ahead", "doc_id", "text").mapInArrow(make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(table(spark, sf_dir, "documents"))

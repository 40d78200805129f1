"""Words and k-grams of whole texts in Arrow batches, on bytes; the same words and runs as scalars.words and scalars.kgrams.

As column functions a run costs a slice, a join and two look-ups in interpreted code; here a text's runs are
joined and hashed in C.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

try:
    from _md5 import md5  # without OpenSSL's set-up for each call
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorfold.functions import scalars as S

WORD = re.compile(rb"[^ \n\t\r]+")


def words(text: bytes) -> list[bytes]:
    """As scalars.words; bytes.split also parts at two further signs, where they occur the pattern decides."""
    return WORD.findall(text) if b"\x0b" in text or b"\x0c" in text else text.split()


def runs(text: bytes | None, k: int = S.KGRAM) -> list[bytes]:
    """Runs of k words, space-joined; none below k."""
    w = words(text or b"")
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def h28(grams: set[bytes]) -> np.ndarray:
    """scalars.h28 of each."""
    return np.frombuffer(b"".join([md5(g).digest()[:4] for g in grams]), ">u4").astype(np.uint64) >> np.uint64(4)


def each_text(texts: DataFrame, id_: str, schema: str, make: Callable[[list, list], pa.RecordBatch]) -> DataFrame:
    """make(ids, texts as bytes) of a batch's rows, as rows of `schema`."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return texts.select(id_, F.col("text").cast("binary").alias("text")).mapInArrow(go, schema)


BITS = 1 << 23  # of a table of hashes, 1 MB whatever is marked


def _bit(gram: bytes) -> int:
    return crc32(gram) % BITS


def gram_bits(texts: DataFrame, id_: str, k: int) -> bytes:
    """A table of BITS bits, those marked where a run of the texts hashes; at most BITS numbers reach the driver."""

    def make(_: list, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array({_bit(g) for t in rows for g in runs(t, k)}, pa.int32())], ["bit"])

    marked = np.zeros(BITS, dtype=bool)
    marked[each_text(texts, id_, "bit int", make).distinct().toArrow().column("bit").to_numpy()] = True
    return np.packbits(marked).tobytes()


def gram_rows(texts: DataFrame, id_: str, k: int, within: bytes | None = None) -> DataFrame:
    """id, gram: the distinct runs of each text; with a table of bits only those that hash to a marked one, which all that were marked do."""

    def kept(t: bytes | None) -> set[bytes]:
        found = set(runs(t, k))
        return found if within is None else {g for g in found if within[(b := _bit(g)) >> 3] & (128 >> (b & 7))}

    def make(ids: list, rows: list) -> pa.RecordBatch:
        sets = [kept(t) for t in rows]
        ids = pa.array([i for i, s in zip(ids, sets, strict=True) for _ in s], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array([g for s in sets for g in s], pa.binary())], [id_, "gram"])

    return each_text(texts, id_, f"{id_} long, gram binary", make)


TOGETHER = 1 << 18  # bytes of texts that are looked at in one go


def _facts(texts: list[bytes], least: int) -> list[tuple]:
    """h, n, loc, parts, size, gram_set, packed of each text, words and lines of all being found at once."""
    mark = np.frombuffer(whole := b"".join(texts), np.uint8)
    edges = np.cumsum([0, *map(len, texts)])
    blank, newline = mark == 32, mark == 10
    space = blank | newline | (mark == 9) | (mark == 13)
    first = ~space
    first[1:] &= space[:-1]
    opening = edges[:-1][np.diff(edges) > 0]
    first[opening] = ~space[opening]  # a text's first word, however the one before ends
    first, breaks = np.flatnonzero(first), np.flatnonzero(newline)
    within = lambda at: np.diff(np.searchsorted(at, edges))
    n, parts, newlines = within(first), within(np.flatnonzero(blank)) + 1, within(breaks)
    starts = np.sort(np.concatenate([edges[:-1], breaks + 1]))
    starts = starts[np.diff(np.searchsorted(first, np.append(starts, len(mark)))) + 1 >= least]
    owner = np.searchsorted(edges, starts, "right") - 1
    stops = np.minimum(edges[owner + 1], np.append(breaks, len(mark))[np.searchsorted(breaks, starts)])
    lines: list[set] = [set() for _ in texts]
    view = memoryview(whole)
    for k, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
        lines[k].add(md5(view[a:b]).digest())
    out = []
    for t, words_, loc, pieces, found in zip(texts, n.tolist(), newlines.tolist(), parts.tolist(), lines, strict=True):
        packed = b"".join(sorted(found))
        out.append((md5(t).hexdigest(), words_, loc + (len(t) > 0 and not t.endswith(b"\n")), pieces, len(found), sha256(packed).digest() if found else None, packed))
    return out


def facts(files_: DataFrame, least: int) -> DataFrame:
    """file_id, path, language, h (md5), n (words), loc, parts (between single spaces), size, gram_set, packed, grams.

    grams: the distinct md5 of the lines of `least` nodes, which are a line's words and one; size: how many; packed:
    their 16 bytes each, in order; gram_set: a hash of these, null without any.
    """
    kinds = {"h": pa.string(), "n": pa.int64(), "loc": pa.int64(), "parts": pa.int64(), "size": pa.int64(), "gram_set": pa.binary(), "packed": pa.binary()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, texts, held = [(None, None, None, None, 0, None, b"")] * len(batch), batch.column(3).to_pylist(), 0
            some: list[int] = []
            for k, t in enumerate([*texts, None]):
                if t is not None:
                    some.append(k)
                    held += len(t)
                if some and (held >= TOGETHER or k == len(texts)):
                    for at, one in zip(some, _facts([texts[x] for x in some], least), strict=True):
                        told[at] = one
                    some, held = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[c] for x in told], kind) for c, kind in enumerate(kinds.values()))], ["file_id", "path", "language", *kinds])

    read = files_.select("file_id", "path", "language", F.col("text").cast("binary").alias("text"))
    made = read.mapInArrow(go, "file_id long, path string, language string, h string, n long, loc long, parts long, size long, gram_set binary, packed binary")
    return made.withColumn("grams", F.when(F.col("size") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.lower(F.hex(_gram(i))))))


def _gram(place: Column) -> Column:
    return F.substring("packed", 16 * place.cast("int") + 1, F.lit(16))


def packed_grams(facts_: DataFrame) -> DataFrame:
    """file_id, gram (16 bytes): the grams of facts, a row each."""
    each = facts_.where("size > 0").select("file_id", "packed", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("place_"))
    return each.select("file_id", _gram(F.col("place_")).alias("gram"))

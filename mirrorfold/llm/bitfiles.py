"""Token ids in fixed-width bit-packed files.

A file: the magic, bits an id (u8), ids a block (u32); then the blocks, each of that many ids (the last
may be shorter) in the least number of bits that the vocabulary needs, from a byte boundary; then the
footer: block offsets (u64 each), document ids (i64), null flags (u8), first id of each document and the
end of the last (u64); then the trailer: blocks, documents, ids, place of the footer (u64 each). A block
is found by its offset alone and unpacked by numpy in one go, so that any range can be read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import need, scratch, table, width
from mirrorfold.llm.tokens import arrow, default_tokenizer, encoder, rows

MAGIC, HEAD, TRAILER = b"MFOLDBIT", struct.Struct("<8sBI"), struct.Struct("<4Q")
BLOCK = 65_536  # ids


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return flat.astype("<u4") @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Streams documents into one file; holds a block of ids and the index."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held, self.n_held = [], 0
        self.offsets, self.ids, self.nulls, self.starts, self.n = [], [], [], [0], 0
        out.write(HEAD.pack(MAGIC, bits, block))
        self.at = HEAD.size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n += len(ids)
        self.starts.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            cut = len(whole) // self.block * self.block
            for at in range(0, cut, self.block):
                self._write(whole[at : at + self.block])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _write(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(data := packed(ids, self.bits)) or len(data)

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        for values, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(TRAILER.pack(len(self.offsets), len(self.ids), self.n, self.at))
        self.out.close()


class Reader:
    """Random access to one file: documents() streams them, ids(a, b) reads the blocks of a range only."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a bit-packed token file")
        end = file.size() - TRAILER.size
        blocks, docs, self.n, at = TRAILER.unpack(self._read(end, TRAILER.size))
        self.footer = at
        index = self._read(at, end - at)
        self.offsets = np.frombuffer(index, "<u8", blocks)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(index, "u1", docs, 8 * (blocks + docs))
        self.starts = np.frombuffer(index, "<u8", docs + 1, 8 * blocks + 9 * docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block_ids(self, k: int) -> np.ndarray:
        at = int(self.offsets[k])
        end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.footer
        return unpacked(self._read(at, end - at), self.bits, min(self.block, self.n - k * self.block))

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids from `first` up to `end` of this file."""
        if first >= end:
            return np.zeros(0, "<u4")
        k = first // self.block
        return np.concatenate([self.block_ids(x) for x in range(k, (end - 1) // self.block + 1)])[first - k * self.block : end - k * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, first id in this file, number of ids, crc32 of them), a block in memory at a time."""
        k, block = -1, None
        for d in range(len(self.doc_ids)):
            at, end, crc = int(self.starts[d]), int(self.starts[d + 1]), 0
            first = at
            while at < end:
                if at // self.block != k:
                    k = at // self.block
                    block = self.block_ids(k)
                stop = min(end, (k + 1) * self.block)
                crc = zlib.crc32(block[at - k * self.block : stop - k * self.block].tobytes(), crc)
                at = stop
            yield None if self.nulls[d] else int(self.doc_ids[d]), first, end - first, crc


def store(folder: str):
    """The file system and path of a folder that driver and executors share (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith(("file:", "/")) else f"/{folder}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> list[tuple[int, str, int, int]]:
    """Write documents in ascending doc_id (nulls first, equal ids by text); rows (shard, file, ids, documents).

    One row a file comes back. A task that is run again writes a file of a new name, and only the files
    named in the result count, so the loss of an executor leaves nothing half-written behind.
    """
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("ids", pa.int64()), ("documents", pa.int64())])

    def make(batches):
        import uuid

        from pyspark import TaskContext

        system, root = store(folder)
        system.create_dir(root, recursive=True)
        encode = encoder(tokenizer)
        shard, writer, end = TaskContext.get().partitionId(), None, np.array([end_id], "<u4")
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.bits"
        for doc_id, text in rows(batches, "doc_id", "text"):
            if writer is None:
                writer = Writer(system.open_output_stream(name), bits_for(encode.tokenizer.get_vocab_size()))
            writer.add(doc_id, np.concatenate([np.frombuffer(encode.ids(text), "<u4"), end]))
        if writer is not None:
            writer.close()
            yield from arrow([(shard, name, writer.n, len(writer.ids))], schema)

    ranged = need(docs, "doc_id", "text").repartitionByRange(width(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = ranged.withColumn("text", F.col("text").cast("binary")).mapInArrow(make, "shard int, file string, ids long, documents long")
    return sorted(tuple(r) for r in made.collect())


def read(spark: SparkSession, folder: str, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """Documents from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before, named = 0, []
    for place, (_, file, n, _) in enumerate(sorted(shards)):
        named.append((place, file, before))
        before += n

    def make(batches):
        system, _ = store(folder)

        def out():
            for file, base in rows(batches, "file", "base"):
                with system.open_input_file(file) as f:
                    for doc_id, start, n, crc in Reader(f).documents():
                        yield doc_id, base + start, n, crc

        yield from arrow(out(), schema)

    files = spark.createDataFrame(named, "place int, file string, base long")
    return files.repartitionById(max(1, len(named)), F.col("place")).mapInArrow(make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_bit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-bits")
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder, default_tokenizer()))

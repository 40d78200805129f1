"""Shared pieces of the training-data operators: tables, checkpoints, identities of tasks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.plans import checkpoints
from mirrorfold.plans.checkpoints import shared_dir

__all__ = ["Memory", "bounded", "cut", "drop", "held", "need", "release", "remainder", "remainder_col", "scratch", "shared_dir", "spare", "table", "texts_of", "width"]

#: ASCII white space; every word of the contracts is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = 8 << 20  # bytes of an Arrow batch, which a task holds on both sides of its Python worker


@contextlib.contextmanager
def bounded(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """What runs here runs in Arrow batches of about `most` bytes; the session's own bound holds if it is lower."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = conf.get(name)
    conf.set(name, str(min(most, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own))))
    try:
        yield
    finally:
        conf.set(name, own)


def cut(df: DataFrame) -> DataFrame:
    """Materialise and forget the lineage, in bounded Arrow batches."""
    with bounded(df.sparkSession):
        return checkpoints.cut(df)


_FOLDERS = checkpoints.FOLDERS


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one; drop() or release() removes it."""
    _FOLDERS.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def drop(spark: SparkSession, *folders: str) -> None:
    """Remove scratch folders that nothing will read again."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _FOLDERS:
            _FOLDERS.remove(folder)


def release(spark: SparkSession) -> None:
    """Remove every scratch folder of this process, once the results that read them are done with."""
    drop(spark, *list(_FOLDERS))


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def width(spark: SparkSession, factor: int = 1) -> int:
    """A number of partitions that follows the session's setting for the size of its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


def need(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that others may carry any name without clashing."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_col(doc_id: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


PIECE = 1 << 20  # bytes of a text that are looked at together


def texts_of(text: bytes | None, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end at spaces, so that no word is cut; a longer word is a piece."""
    text, at = text or b"", 0
    while len(text) - at > size:
        end = text.rfind(b" ", at + 1, at + size)
        end = end if end > 0 else text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Memory:
    """What short words gave, within a number of bytes; when it is full it starts afresh.

    `known` is a plain dictionary: a set's difference with one looks up the set's words, with any other
    mapping it would go through all that is remembered.
    """

    LONG, EACH = 48, 180  # bytes: longer words are not remembered; an entry takes so much besides its contents

    def __init__(self, most: int):
        self.known: dict[bytes, bytes] = {}
        self.most, self.size = most, 0

    def room(self) -> dict[bytes, bytes]:
        if self.size > self.most:
            self.known.clear()
            self.size = 0
        return self.known

    def keep(self, found: Iterable[tuple[bytes, bytes]]) -> None:
        for word, value in found:
            if len(word) <= self.LONG:
                self.known[word] = value
                self.size += len(word) + len(value) + self.EACH


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a worker keeps from task to task for one purpose.

    Workers outlive their stages. One that turns to another purpose drops what it held for the last and
    gives the memory back, so that purposes don't add up.
    """
    if name not in _HELD:
        _HELD.clear()
        trim()
        _HELD[name] = make()
    return _HELD[name]


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    f = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if f:
        f(0)

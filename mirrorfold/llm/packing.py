"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Only the counts of each length reach the driver: at most `capacity` rows, whatever the input. There
the classic rule runs on counts: lengths descend, a segment tree over the remaining capacities finds
the tightest open sequence in logarithmic time, and a run of equal pieces that goes to equally full
sequences is placed as one step. The steps (a few per length) are joined back by length and rank.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mirrorfold.llm.common import cut, need, table
from mirrorfold.llm.tokens import arrow, default_tokenizer, encoder, rows

CAPACITY = 2048

PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first_rank", "end_rank", "first_sequence", "each", "first_offset")])


class OpenBins:
    """Counts of open bins by remaining capacity under a segment tree: tightest(n) takes O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, deque[list[int]]] = defaultdict(deque)

    def add(self, left: int, first: int, count: int) -> None:
        """`count` bins with consecutive numbers from `first`, `left` tokens free in each."""
        if left and count:
            self.runs[left].append([first, count])
            self._change(left, count)

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to `most` consecutive bins of those with `left` tokens free: (first number, how many)."""
        run = self.runs[left][0]
        first, n = run[0], min(most, run[1])
        run[0], run[1] = first + n, run[1] - n
        if not run[1]:
            self.runs[left].popleft()
        self._change(left, -n)
        return first, n

    def _change(self, left: int, by: int) -> None:
        at = left + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that still holds `length`."""
        at = length + self.leaves
        if self.tree[at]:
            return length
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: how many}: rows of PLAN, each a run of ranks within a length.

    Rank k of a run goes to sequence first_sequence + (k - first_rank) // each, at offset
    first_offset + (k - first_rank) % each * length.
    """
    bins, made, steps = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            left = bins.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = made, max(1, (end - rank) // each)
                made += n
            else:
                each = left // length
                first, n = bins.take(left, max(1, (end - rank) // each))
            each = min(each, end - rank)
            steps.append((length, rank, rank + n * each, first, each, capacity - left))
            bins.add(left - each * length, first, n)
            rank += n * each
    return steps


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's tokens and end id, cut into pieces of at most `capacity`.

    chunk and nth number the pieces of a length within the task that made them.
    """
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int32()), ("nth", pa.int64())])

    def make(batches) -> Iterator:
        import zlib
        from collections import Counter

        from pyspark import TaskContext

        encode, chunk, seen = encoder(tokenizer).ids, TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")

        def out():
            for doc_id, text in rows(batches, "doc_id", "text"):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    yield doc_id, piece, at // 4, n, zlib.crc32(part), chunk, seen[n]
                    seen[n] += 1

        yield from arrow(out(), schema)

    return need(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(make, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack documents (doc_id, text; others ignored) into sequences of at most `capacity` tokens.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they occur, null
    ids like any other. Ties between equal lengths go by task and order of rows. No rows: no result rows.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id))
    by_chunk = cut(made.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    steps = spark.createDataFrame(plan(counts, capacity), PLAN)
    k, run = F.col("before") + F.col("nth"), F.col("before") + F.col("nth") - F.col("first_rank")
    return (
        made.join(ranks, ["length", "chunk"])
        .join(F.broadcast(steps), "length")  # a few steps for each of at most `capacity` lengths
        .where((k >= F.col("first_rank")) & (k < F.col("end_rank")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.floor(run / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first_offset") + F.pmod(run, F.col("each")) * F.col("length")).cast("long").alias("offset"))
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

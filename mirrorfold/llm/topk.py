"""Exact top-k search by inner product, pruned by multi-resolution segment statistics.

A vector is described, at each resolution, by the mean and the deviation of its segments. For any two
vectors the negated product, the distance that ranks them, is at least
-sum(length * (mean * mean' + deviation * deviation')) over the segments. Coarse bounds come first; pairs
that they can't exclude meet the finer ones; for survivors alone the product is computed.

What a pair must reach is known beforehand: a share of the rows is searched first, and a query's k-th best
there is its floor. So a row block sends on only what may be among the best of all, whatever its size.
Queries lie in a table in the shared folder and each task streams them past its rows, a block at a time,
so nothing grows in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.llm.common import drop, need, scratch, table
from mirrorfold.llm.tokens import arrow

K, SCALE, LEVELS = 10, 1024, (4, 16, 32)  # segments at each resolution, coarse to fine
QUERIES, ROWS = 256, 16_384  # a block of each
FLOORS = 8  # one row in so many is searched first


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of segment means and deviations, each times the root of its length: bounds are products of rows."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = np.empty((len(x), 2 * len(parts)))
    for k, p in enumerate(parts):
        s = x[:, p[0] : p[-1] + 1]
        out[:, k] = s.mean(axis=1) * np.sqrt(len(p))
        out[:, len(parts) + k] = s.std(axis=1) * np.sqrt(len(p))
    return out


def survivors(floor: np.ndarray, q_sums: list, x_sums: list) -> np.ndarray:
    """Which pairs no resolution excludes: queries x rows."""
    # rounding of a bound is far below 1, and products are integers
    at = (q_sums[0] @ x_sums[0].T + 0.5 >= floor[:, None]) if q_sums else None
    for qs, xs in zip(q_sums[1:], x_sums[1:], strict=True):
        for k, row in enumerate(at):
            left = np.flatnonzero(row)
            at[k, left] = xs[left] @ qs[k] + 0.5 >= floor[k]
    return at


def best(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, q_sums: list, x_sums: list, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query id, id, product, survivors) of the k best rows of x for each row of q that reach its floor, ties to smaller ids, own ids left out.

    A query's survivors stand on its first row; a query without rows gives (query id, None, None, survivors).
    """
    for row, q_id, least, vector in zip(survivors(floor, q_sums, x_sums), q_ids.tolist(), floor, q, strict=True):
        some = np.flatnonzero(row & (ids != q_id))
        n, score = len(some), x[some] @ vector
        some, score = some[score >= least], score[score >= least]
        if len(some) > k:
            low = np.partition(score, -k)[-k]
            some, score = some[score >= low], score[score >= low]
        order = np.lexsort((ids[some], -score))[:k]
        for at, product in zip(ids[some[order]].tolist(), score[order].tolist(), strict=True):
            yield q_id, at, int(product), n
            n = 0
        if n:
            yield q_id, None, None, n


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return need(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def matrix(column, dims: int, scale: float = SCALE) -> np.ndarray:
    return np.floor(scale * np.asarray(column.flatten(), dtype=np.float64)).reshape(-1, dims)


def searched(rows: DataFrame, folder: str, k: int, scale: float, levels: tuple[int, ...]) -> DataFrame:
    """Each query of the folder (vec_id, embedding, floor) against each block of rows: query_id, vec_id, score, survivors."""
    import pyarrow as pa

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("survivors", pa.int64())])

    def queries(dims: int):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in ds.dataset(root, filesystem=system, format="parquet").to_batches(batch_size=QUERIES):
            of = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch["embedding"]), dims))
            if of.num_rows:
                q = matrix(of["embedding"], dims, scale)
                yield q, np.asarray(of["vec_id"]), np.asarray(of["floor"]), [summaries(q, s) for s in levels]

    def make(batches):
        import pyarrow.compute as pc  # noqa: F401

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lengths = pc.list_value_length(part["embedding"])
                for dims in pc.unique(lengths).to_pylist():
                    of = part.filter(pc.equal(lengths, dims))
                    x, ids = matrix(of["embedding"], dims, scale), np.asarray(of["vec_id"])
                    sums = [summaries(x, s) for s in levels]
                    for q, q_ids, floor, q_sums in queries(dims):
                        yield from arrow(best(q, q_ids, floor, x, ids, q_sums, sums, k), schema)

    return rows.select("vec_id", "embedding").mapInArrow(make, "query_id long, vec_id long, score long, survivors long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_floors(vectors: DataFrame, query: F.Column, k: int, scale: float, levels: tuple[int, ...]) -> tuple[DataFrame, str]:
    """The usable rows, and the folder of their queries with floors: the k-th best product in a share of the rows, if it has k."""
    spark, rows = vectors.sparkSession, usable(vectors)
    first, folder = scratch(spark, "queries"), scratch(spark, "queries")
    told = rows.where(query).dropDuplicates(["vec_id"]).select("vec_id", "embedding")
    told.withColumn("floor", F.lit(float("-inf"))).write.parquet(first)
    queries = spark.read.parquet(first)
    share = searched(rows.where(F.pmod(F.xxhash64("vec_id", F.lit("floor")), F.lit(FLOORS)) == 0), first, k, scale, levels)
    kth = ranked(share, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    queries.join(kth, "vec_id", "left").select("vec_id", "embedding", F.coalesce("least", "floor").alias("floor")).write.parquet(folder)
    drop(spark, first)
    return rows, folder


def search(vectors: DataFrame, query: F.Column, k: int = K, scale: float = SCALE, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Each query's k best rows of its own length: query_id, rank, vec_id, score.

    Components become floor(scale * x). Null vectors, vectors with a null or non-finite component and null
    ids take no part. Repeated rows of an id count as one candidate each of that id, a repeated query as
    one query; a query's own id is no candidate. Products are exact below 2**53. Fewer rows: fewer results.
    Columns of other names are left out, whatever they are.
    """
    rows, folder = with_floors(vectors, query, k, scale, levels)
    return ranked(searched(rows, folder, k, scale, levels), k).select("query_id", "rank", "vec_id", "score")


def survivor_share(vectors: DataFrame, query: F.Column, k: int = K, scale: float = SCALE, levels: tuple[int, ...] = LEVELS) -> float:
    """The share of all pairs of a query and a row whose product is computed in the last pass."""
    rows, folder = with_floors(vectors, query, k, scale, levels)
    n = searched(rows, folder, k, scale, levels).agg(F.sum("survivors")).first()[0] or 0
    return n / max(1, rows.count() * vectors.sparkSession.read.parquet(folder).count())


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

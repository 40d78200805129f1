"""Queries over published clusters: filters, pages, budgets, ranges, lookups, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.functions import scalars as S

CAP, LIMIT, BUDGET, PREFIX = 100, 5, 15, 7


def filtered(clusters: DataFrame, occurrences: DataFrame, kinds: list[str] | None = None, languages: list[str] | None = None, severities: list[str] | None = None, path: str | None = None, min_size: int | None = None) -> DataFrame:
    """No kinds listed means none, no languages or severities listed means any; a path matches any occurrence."""
    out = clusters
    if kinds is not None:
        out = out.where(F.col("kind").isin(kinds)) if kinds else out.limit(0)
    if severities:
        out = out.where(F.col("severity").isin(severities))
    if min_size is not None:
        out = out.where(F.col("copies") >= min_size)
    seen = occurrences
    if languages:
        out = out.join(seen.where(F.col("language").isin(languages)).select("cluster_id"), "cluster_id", "left_semi")
    if path:
        out = out.join(seen.where(F.col("path").contains(path)).select("cluster_id"), "cluster_id", "left_semi")
    return out


def page(clusters: DataFrame, offset: int = 0, limit: int = LIMIT, budget: int = BUDGET) -> DataFrame:
    """Rows from `offset` while the occurrences budget lasts; the row at its end is cut (shown < copies), later ones are not sent."""
    rows = clusters.orderBy(F.col("rank") == 0, "rank", "cluster_id").offset(offset).limit(limit)
    before = F.coalesce(F.sum("copies").over(Window.orderBy("rank", "cluster_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # `limit` rows
    return rows.withColumn("before_", before).where(F.col("before_") < budget).withColumn("shown", F.least("copies", F.lit(budget) - F.col("before_"))).drop("before_")


def truncated(occurrences: DataFrame, cap: int = CAP) -> DataFrame:
    """The first `cap` occurrences of each cluster with the total, and whether some are missing."""
    of, total = Window.partitionBy("cluster_id"), F.count("*").over(Window.partitionBy("cluster_id"))
    n = F.row_number().over(of.orderBy("path", "start_line"))
    return occurrences.withColumn("n_", n).withColumn("occurrences_total", total).where(F.col("n_") <= cap).withColumn("truncated", F.col("occurrences_total") > cap).drop("n_")


def for_range(occurrences: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return occurrences.where((F.col("path") == path) & S.overlaps(F.col("start"), F.col("end"), F.lit(start), F.lit(end)))


def by_prefix(clusters: DataFrame, prefix: str) -> DataFrame:
    if len(prefix) < PREFIX:
        raise ValueError(f"a cluster id's prefix has {PREFIX} digits at least")
    return clusters.where(F.col("cluster_id").startswith(prefix))


def delta(before: DataFrame, after: DataFrame, key: str = "cluster_id") -> DataFrame:
    """key, change: added, removed or updated; unchanged rows are left out."""
    rest = [c for c in before.columns if c != key]
    a, b = before.select(key, F.struct(*rest).alias("x")), after.select(key, F.struct(*rest).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "updated")
    return a.join(b, key, "full_outer").withColumn("change", change).where(F.col("change").isNotNull()).select(key, "change")


def find_similar(hashes: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """(file_id, hash) x (probe_id, hash) -> the `most` files that share the most hashes with each probe."""
    hit = hashes.select("file_id", "hash").distinct().join(probes.select("probe_id", "hash").distinct(), "hash").groupBy("probe_id", "file_id").agg(F.count("*").alias("shared"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("shared"), "file_id")).cast("long")).where(F.col("rank") <= most)


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("clusters"))

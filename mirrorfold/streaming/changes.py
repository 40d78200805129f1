"""Change logs, batch and streaming: bursts, the latest text, no-ops, incremental pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.operators import candidates

QUIET_MS, CAP_MS = 250, 2_000


def bursts(log: DataFrame, group: str, path: str, seconds: int) -> DataFrame:
    """Runs of events no more than `seconds` apart: group, burst, events, paths."""
    order = Window.partitionBy(group).orderBy("ts", path)
    apart = F.col("ts") - F.lag("ts").over(order) <= F.make_dt_interval(secs=F.lit(seconds))
    numbered = log.withColumn("new_", F.when(apart, 0).otherwise(1)).withColumn("burst", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(group, "burst").agg(F.count("*").alias("events"), F.countDistinct(path).alias("paths"))


def latest(log: DataFrame, path: str, version: str, text: str) -> DataFrame:
    """The text of each path's highest version; works on a stream too."""
    return log.groupBy(path).agg(F.max(version).alias(version), F.max_by(text, version).alias(text))


def noops(log: DataFrame, path: str, version: str, text: str) -> DataFrame:
    """Versions that leave the text as it was."""
    before = F.lag(F.md5(text)).over(Window.partitionBy(path).orderBy(version))
    return log.select(path, version, F.md5(text).eqNullSafe(before).alias("noop"))


def applied(state: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """State after a batch of (key, op, …): upserts replace, deletes remove."""
    return state.join(batch.select(key), key, "left_anti").unionByName(batch.where("op <> 'delete'").drop("op"))


def incremental_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Equal-hash star pairs of old and new files together, from the old centres and the new rows alone.

    Only buckets that the new files touch are drawn again; the result is that of a cold run.
    """
    hashed = lambda f: f.select("file_id", "language", F.md5("text").alias("hash"))
    a, b = hashed(old), hashed(new)
    touched = b.select("language", "hash").distinct()
    kept = candidates.stars(a.join(touched, ["language", "hash"], "left_anti"), "language", "hash")
    again = candidates.stars(a.join(touched, ["language", "hash"], "left_semi").unionByName(b), "language", "hash")
    return kept.unionByName(again).select("left", "right")


def debounced(stream: DataFrame, quiet: str = "250 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Structured Streaming: (ts, root, path) -> flushes of a root's distinct, sorted paths after each quiet gap."""
    flushes = stream.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "root").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return flushes.select("root", "w.start", "w.end", "paths")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose content the cache lacks."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti").select(wanted.columns)


def since(log: DataFrame, path: str, version: str, text: str, generation: int) -> DataFrame:
    """path, change: paths that are new or other than they were at a generation; the log keeps every version."""
    at = lambda rows, name: rows.groupBy(path).agg(F.max_by(F.md5(text), version).alias(name))
    then, now = at(log.where(F.col(version) <= generation), "then"), at(log, "now")
    both = now.join(then, path, "left").where(~F.col("now").eqNullSafe(F.col("then")))
    return both.select(path, F.when(F.col("then").isNull(), "added").otherwise("updated").alias("change"))

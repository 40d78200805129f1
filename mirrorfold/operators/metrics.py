"""Duplication metrics of the corpus, its kinds, files and folders, and of a diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.functions import scalars as S


def analysed(files_: DataFrame) -> DataFrame:
    return files_.select("file_id", "path", "language", S.line_count(F.col("text")).alias("analysed_loc"))


def duplicated_lines(occurrences: DataFrame) -> DataFrame:
    """(kind, path, start_line, end_line) -> distinct (kind, path, line)."""
    return occurrences.select("kind", "path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def corpus(files_: DataFrame, lines_: DataFrame) -> DataFrame:
    """One row: analysed, duplicated, percent, duplicated_files."""
    a = files_.agg(F.coalesce(F.sum("analysed_loc"), F.lit(0)).alias("analysed_loc"))
    d = lines_.select("path", "line").distinct().agg(F.count("*").alias("duplicated_loc"), F.countDistinct("path").alias("duplicated_files"))
    return a.crossJoin(F.broadcast(d)).withColumn("percent", S.percent(F.col("duplicated_loc"), F.col("analysed_loc")))  # one row each


def by_kind(lines_: DataFrame, total: DataFrame) -> DataFrame:
    return lines_.groupBy("kind").agg(F.count("*").alias("duplicated_loc")).crossJoin(F.broadcast(total.select("analysed_loc"))).withColumn("percent", S.percent(F.col("duplicated_loc"), F.col("analysed_loc")))


def by_file(files_: DataFrame, lines_: DataFrame) -> DataFrame:
    d = lines_.select("path", "line").distinct().groupBy("path").agg(F.count("*").alias("duplicated_loc"))
    return files_.select("path", "analysed_loc").join(d, "path", "full_outer").na.fill(0, ["analysed_loc", "duplicated_loc"]).withColumn("percent", S.percent(F.col("duplicated_loc"), F.col("analysed_loc")))


def by_folder(per_file: DataFrame) -> DataFrame:
    """Every folder above a file, clean files in the denominator, folders without duplicates left out."""
    parts = F.split("path", "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    summed = per_file.select(F.explode(folders).alias("folder"), "analysed_loc", "duplicated_loc").groupBy("folder").agg(F.sum("analysed_loc").alias("analysed_loc"), F.sum("duplicated_loc").alias("duplicated_loc"))
    return summed.where("duplicated_loc > 0").withColumn("percent", S.percent(F.col("duplicated_loc"), F.col("analysed_loc")))


def breached(measured: Column, limit: Column, source: Column) -> Column:
    """Strictly above a limit that someone set."""
    return source.isNotNull() & (source != "none") & (measured > limit)


def spans(lines_: DataFrame) -> DataFrame:
    """(path, line) -> merged spans: path, first, last."""
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return lines_.distinct().withColumn("island", island).groupBy("path", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")


def diff_tags(occurrences: DataFrame, added: DataFrame) -> DataFrame:
    """(cluster, path, start_line, end_line, hidden) x added spans -> cluster, intersects_diff, is_newly_introduced."""
    hit = occurrences.join(added, "path").where((F.col("first") <= F.col("end_line")) & (F.col("start_line") <= F.col("last"))).select("cluster", "path", "start_line", "end_line").distinct().withColumn("in_diff", F.lit(True))
    tagged = occurrences.join(hit, ["cluster", "path", "start_line", "end_line"], "left").withColumn("in_diff", F.coalesce("in_diff", F.lit(False)))
    per = tagged.groupBy("cluster").agg(F.bool_or(F.col("in_diff") & ~F.col("hidden")).alias("intersects_diff"), F.bool_and("in_diff").alias("all_in"))
    return per.select("cluster", "intersects_diff", (F.col("intersects_diff") & F.col("all_in")).alias("is_newly_introduced"))


def diff_metrics(lines_: DataFrame, added: DataFrame) -> DataFrame:
    """Duplicated lines among the added ones."""
    both = lines_.select("path", "line").distinct().join(added.select("path", "line").distinct(), ["path", "line"])
    return both.agg(F.count("*").alias("duplicated_added")).crossJoin(F.broadcast(added.select("path", "line").distinct().agg(F.count("*").alias("added")))).withColumn("percent", S.percent(F.col("duplicated_added"), F.col("added")))


def worst_first(per_path: DataFrame, most: int) -> DataFrame:
    """The `most` paths of the highest percent, ties by path, with their rank; only they are ranked."""
    top = per_path.orderBy(F.desc("percent"), "path").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("percent"), "path")).cast("long"))  # `most` rows

"""Findings about literals and constants: repeated, shadowed, duplicate, drifting, aliased."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def magic(sites: DataFrame, across: int = 3, within: int = 5) -> DataFrame:
    """Values at `across` sites over two files or more, or at `within` sites of one."""
    return sites.groupBy("value").agg(F.count("*").alias("sites"), F.countDistinct("file_id").alias("files")).where(((F.col("sites") >= across) & (F.col("files") >= 2)) | (F.col("sites") >= within))


def shadowed(sites: DataFrame, constants: DataFrame) -> DataFrame:
    """Inline values that a constant already names."""
    return sites.join(constants.select("name", "value").distinct(), "value").groupBy("name", "value").agg(F.count("*").alias("sites"))


def duplicates(constants: DataFrame) -> DataFrame:
    return constants.groupBy("name", "value").agg(F.count("*").alias("places")).where("places >= 2")


def drift(constants: DataFrame) -> DataFrame:
    return constants.groupBy("name").agg(F.countDistinct("value").alias("values")).where("values >= 2")


def aliases(constants: DataFrame) -> DataFrame:
    return constants.groupBy("value").agg(F.countDistinct("name").alias("names")).where("names >= 2")


def capped(findings: DataFrame, cap: int) -> DataFrame:
    """The heaviest `cap` findings of each kind, with how many of the kind are hidden."""
    of = Window.partitionBy("kind")
    return findings.withColumn("n_", F.row_number().over(of.orderBy(F.desc("mass"), "id"))).withColumn("hidden", F.greatest(F.count("*").over(of) - cap, F.lit(0))).where(F.col("n_") <= cap).drop("n_")


def keyed(sites: DataFrame) -> DataFrame:
    """(file_id, value) -> number, content, sites, spellings: numbers meet by their value, other literals by their content."""
    told = sites.withColumn("number", F.expr("try_cast(value AS double)"))
    key = F.when(F.col("number").isNull(), F.col("value"))
    return told.groupBy("number", key.alias("content")).agg(F.count("*").alias("sites"), F.countDistinct("value").alias("spellings"))

"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder in a local run and an error on a cluster, whose executors share no such folder."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="mirrorfold-"))
    return told or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise and forget the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


FOLDERS: list[str] = []  # what written() and others have put below the shared folder


def written(df: DataFrame) -> DataFrame:
    """As cut(), for large tables that are read again and again: a reader takes only the columns that it asks for.

    Rows of a checkpoint go through Java's serialisation one by one, each time all of them.
    """
    FOLDERS.append(f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}")
    df.write.parquet(FOLDERS[-1])
    return df.sparkSession.read.schema(df.schema).parquet(FOLDERS[-1])

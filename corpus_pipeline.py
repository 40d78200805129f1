"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import drop, need, scratch, table
from mirrorfold.llm.mixing import repeated
from mirrorfold.llm.neardup import keep_one
from mirrorfold.llm.packing import pack
from mirrorfold.llm.pii import session_key, with_surrogates
from mirrorfold.llm.toxicity import keep_clean

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts score as the bias says, repeated rows alike. Without two labels to learn from the
    share of the one decides for all. An empty table stays empty.
    """
    return keep_clean(need(docs, *COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least id.

    Texts without words are near nothing and stay; rows without an id stay; of repeated rows one stays; the
    several texts of one id stay or go together. An empty table stays empty.
    """
    return keep_one(need(docs, *COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates under the session's key; n_chars follows a text that changed.

    Null, empty and clean texts stay as they are, every row stays, and equal texts stay equal.
    """
    made = with_surrogates(need(docs, *COLUMNS), session_key(spark))
    return made.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source; texts without words have no size and go where their place says; rows alike in
    id, source and size are taken equally often. An empty table stays empty.
    """
    return repeated(need(docs, *COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places.

    Null and empty texts hold the end id alone; repeated rows are packed as often as they occur. An empty
    table gives no pieces.
    """
    return pack(need(docs, *COLUMNS))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is dropped once the next is written; the last one's is read by the result."""
    folder, docs = scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs

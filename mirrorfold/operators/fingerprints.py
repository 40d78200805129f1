"""From files to fingerprints: lines as statements, sibling windows, k-grams, whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.functions import scalars as S
from mirrorfold.functions import texts

WIDTHS = range(2, 9)


def files(docs: DataFrame) -> DataFrame:
    """documents as files: file_id, path, language, text."""
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), "text")


def normalised(text: Column) -> Column:
    """Case folded, words with digits as one literal kind."""
    return F.regexp_replace(F.lower(text), r"[^ \n\t\r]*[0-9][^ \n\t\r]*", "__literal__")


def lines(files_: DataFrame) -> DataFrame:
    """Statements: file_id, ordinal, line, start, end, nodes (words and the line itself), hash."""
    each = files_.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    before = Window.partitionBy("file_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))
    return each.select("file_id", F.col("ordinal").cast("long").alias("ordinal"), "line", "start", (F.col("start") + F.length("line")).alias("end"), (F.size(S.words(F.col("line"))) + 1).cast("long").alias("nodes"), F.md5("line").alias("hash"))


def line_fingerprints(files_: DataFrame, min_nodes: int) -> DataFrame:
    return lines(files_).where(F.col("nodes") >= min_nodes)


def sibling_windows(lines_: DataFrame) -> DataFrame:
    """Every run of 2..8 consecutive statements: file_id, ordinal, width, nodes, start, end, uniform, hash.

    One pass over one window of the widest frame; widths are taken from its list, so the input is not
    multiplied before the shuffle.
    """
    ahead = Window.partitionBy("file_id").orderBy("ordinal").rowsBetween(0, max(WIDTHS) - 1)
    listed = lines_.select("file_id", "ordinal", "start", F.collect_list(F.struct("hash", "nodes", "end")).over(ahead).alias("run"))
    each = listed.withColumn("width", F.explode(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w <= F.size("run"))))
    run = F.slice("run", 1, F.col("width"))
    each = each.withColumn("run", run)
    hashes = F.transform("run", lambda x: x["hash"])
    return each.select(
        "file_id", "ordinal", F.col("width").cast("long").alias("width"), F.aggregate("run", F.lit(0).cast("long"), lambda s, x: s + x["nodes"]).alias("nodes"),
        "start", F.element_at("run", -1)["end"].alias("end"), (F.size(F.array_distinct(hashes)) == 1).alias("uniform"), F.md5(F.concat_ws("|", F.lit("window"), F.col("width").cast("string"), F.array_join(hashes, ","))).alias("hash"),
    )


def kept_windows(windows: DataFrame, min_nodes: int) -> DataFrame:
    """Uniform windows and small ones say nothing."""
    return windows.where(~F.col("uniform") & (F.col("nodes") >= min_nodes))


def boilerplate_lines(lines_: DataFrame, min_files: int) -> DataFrame:
    """Lines that recur over many files: hash, line, files."""
    return lines_.where(F.length("line") > 0).groupBy("hash", "line").agg(F.countDistinct("file_id").alias("files")).where(F.col("files") >= min_files)


def token_kgrams(files_: DataFrame, k: int = S.KGRAM) -> DataFrame:
    """file_id, gram, n: each file's k-grams with their counts."""
    return files_.select("file_id", F.explode(S.kgrams(S.words(F.col("text")), k)).alias("gram")).groupBy("file_id", "gram").agg(F.count("*").alias("n"))


def gram_digests(files_: DataFrame, k: int = S.KGRAM) -> DataFrame:
    """file_id, grams, distinct_grams, least (md5) of the files that have k-grams.

    A text's grams are counted where it is read and only their figures leave the task. Texts that share an id
    are one file: their grams, and theirs alone, meet in a shuffle.
    """

    def make(ids: list, rows: list) -> pa.RecordBatch:
        told = []
        for t in rows:
            every = texts.runs(t, k)
            distinct = set(every)
            told.append((len(every), len(distinct), min((texts.md5(g).digest() for g in distinct), default=b"").hex()))
        counts = [pa.array([x[c] for x in told], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts], ["file_id", "grams", "distinct_grams", "least"])

    repeated = files_.groupBy("file_id").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("file_id").alias("again_"))
    again, same = not repeated.isEmpty(), F.col("file_id").eqNullSafe(F.col("again_"))
    alone = files_.join(repeated, same, "left_anti") if again else files_
    one = texts.each_text(alone, "file_id", "file_id long, grams long, distinct_grams long, least string", make).where("grams > 0")
    if not again:
        return one
    more = token_kgrams(files_.join(repeated, same, "left_semi"), k)
    return one.unionByName(more.groupBy("file_id").agg(F.sum("n").alias("grams"), F.count("*").alias("distinct_grams"), F.min(F.md5("gram")).alias("least")))

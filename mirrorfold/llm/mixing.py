"""Mixing sources to target weights by weighted fair queueing.

The documents of a source wait in a keyed random order, twice over. Each gets a virtual finish time: the
source's words up to its end, divided by the source's target. All are ordered by that time and taken
while their sum stays within the budget. Words come evenly along virtual time, so equal ranges of it hold
equal work: range sums find the range where the budget ends, and only that range is looked at closely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.llm.common import WORD, cut, need, table, width

SHARE, MOST, RANGES = 1.5, 2, 4096
WEIGHTS = (3, 1, 2)


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_of(doc_id: str) -> Column:
    """A keyed place of a document in its source's queue, 0 to 2**60."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> with weight and target: shares by weight, at most MOST times the size, the excess shared anew.

    One row a source. In order of size to weight the full sources come first; the level that the rest
    share is the first that leaves its own source unfilled.
    """
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ordered = Window.orderBy(MOST * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(MOST * F.col("source_size")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tried = ranked.withColumn("level", (F.lit(SHARE) * total - full) / rest)
    open_level = F.when(MOST * F.col("source_size") >= F.col("level") * F.col("weight"), F.struct(MOST * F.col("source_size") / F.col("weight"), F.col("level")))
    level = F.min(open_level).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return tried.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), level * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and times (how often the document is in the mix) of each row.

    Sizes count words; null and empty texts have 0 and are taken as often as their place says. A null
    source is a source. Repeated rows queue one behind the other, rows alike in all that counts share a
    place. Reruns give the same rows. No rows: no result rows.
    """
    spark = docs.sparkSession
    slots = 1 << (width(spark, 8) - 1).bit_length()  # parts of a queue, for parallel running sums
    sized = cut(need(docs, "doc_id", "source", "text").select("doc_id", "source", words("text").alias("size"), order_of("doc_id").alias("place")).withColumn("slot", F.floor(F.col("place") / F.lit((1 << 60) // slots)).cast("int")))
    by_slot = cut(sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")))
    told = targets(by_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")))
    queue = Window.partitionBy("source").orderBy("slot")
    begun = by_slot.withColumn("before", F.sum("slot_size").over(queue) - F.col("slot_size"))
    begun = begun.join(told, begun["source"].eqNullSafe(told["source"])).select(begun["source"], "slot", "before", "source_size", "target")
    within = Window.partitionBy(sized["source"], sized["slot"]).orderBy("place", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    finish = lambda again: (again * F.col("source_size") + F.col("before") + F.col("through")) / F.greatest(F.col("target"), F.lit(1e-9))
    queued = cut(
        sized.join(begun, sized["source"].eqNullSafe(begun["source"]) & (sized["slot"] == begun["slot"]))
        .select("doc_id", sized["source"], "size", "source_size", "target", "before", F.sum("size").over(within).alias("through"))
        .select("doc_id", "source", "size", "source_size", "target", finish(F.lit(0)).alias("first"), finish(F.lit(1)).alias("second"))
    )
    each = queued.select("size", F.explode(F.array("first", "second")).alias("at")).withColumn("range", F.least(F.floor(F.col("at") * RANGES), F.lit(2 * RANGES)))
    ranges = each.groupBy("range").agg(F.sum("size").alias("range_size"))
    budget = by_slot.agg(F.floor(F.lit(SHARE) * F.sum("slot_size")).alias("budget"))
    along = Window.orderBy("range")
    edge = ranges.withColumn("before_range", F.sum("range_size").over(along) - F.col("range_size")).crossJoin(F.broadcast(budget)).where(F.col("before_range") + F.col("range_size") > F.col("budget")).agg(F.min(F.struct("range", "before_range", "budget")).alias("e")).select("e.*")
    last = each.join(F.broadcast(edge), "range").groupBy("at", "before_range", "budget").agg(F.sum("size").alias("size"))
    last = last.withColumn("sum", F.sum("size").over(Window.orderBy("at")) + F.col("before_range"))
    # A row, null where the whole fits: the last finish time within the budget, or else the edge's own start
    end = last.agg(F.max(F.when(F.col("sum") <= F.col("budget"), F.col("at"))).alias("end"), F.min("at").alias("over")).select(F.coalesce("end", F.col("over") - 1e-12).alias("end"))
    times = F.when(F.col("end").isNull(), F.lit(2)).otherwise((F.col("first") <= F.col("end")).cast("int") + (F.col("second") <= F.col("end")).cast("int"))
    return queued.crossJoin(F.broadcast(end)).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def repeated(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as many times as it is taken; the columns of docs, whatever their names.

    Rows of one id with equal source and size share their place, so the mix takes them equally often.
    """
    told = mix(docs).select("doc_id", "source", "size", "times").distinct().where("times > 0")
    rows = docs.select(F.col("doc_id").alias("id_"), F.col("source").alias("from_"), words("text").alias("words_"), F.struct("*").alias("row_"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("from_")) & (F.col("size") == F.col("words_"))
    return rows.join(told, same).select("row_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row_.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


#: The same queue over whole windows. Finish times are doubles of the same operations in the same order.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS place
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
tried AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ranked),
told AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (
    SELECT level FROM tried WHERE 2 * source_size >= level * weight ORDER BY 2 * source_size / weight, source NULLS LAST LIMIT 1)) AS target
  FROM tried),
queued AS (
  SELECT doc_id, size, source_size, target,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS through
  FROM sized s JOIN told t ON s.source IS NOT DISTINCT FROM t.source),
each AS (
  SELECT size, unnest([through / greatest(target, 1e-9), (source_size + through) / greatest(target, 1e-9)]) AS vt FROM queued),
summed AS (SELECT vt, sum(sum(size)) OVER (ORDER BY vt) AS upto FROM each GROUP BY vt),
cut AS (SELECT max(vt) AS fin FROM summed WHERE upto <= (SELECT floor(1.5 * sum(size)) FROM sized))
SELECT doc_id, size, source_size, target,
       size * (CAST(through / greatest(target, 1e-9) <= fin AS INT) + CAST((source_size + through) / greatest(target, 1e-9) <= fin AS INT)) AS taken,
       CAST(through / greatest(target, 1e-9) <= fin AS INT) + CAST((source_size + through) / greatest(target, 1e-9) <= fin AS INT) AS times
FROM queued, cut
"""

"""From components to ranked clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.functions import scalars as S

# Clone kinds from strong to weak
KINDS = ("identical", "nearly_identical", "same_behavior", "loosely_similar", "structural_only")


def strength(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, reversed(KINDS))), kind), F.lit(0)).cast("long")


def members(roots: DataFrame) -> DataFrame:
    """Components of two or more: component, sorted members."""
    return roots.groupBy(F.col("root").alias("component")).agg(F.sort_array(F.collect_list("node")).alias("members")).where(F.size("members") >= 2)


def masses(occurrences: DataFrame) -> DataFrame:
    """(component, file_id, nodes, hidden) -> component, copies, canonical_nodes, mass."""
    made = occurrences.groupBy("component").agg(F.count("*").alias("copies"), F.count_if(~F.col("hidden")).alias("visible"), F.min("nodes").alias("canonical_nodes"))
    return made.where("copies >= 2").withColumn("mass", F.col("canonical_nodes") * F.greatest(F.col("visible") - 1, F.lit(0)))


def ranked(clusters: DataFrame, clone: Column, most: int | None = None) -> DataFrame:
    """Clones by mass, then id; information is rank 0 and comes last.

    most: only so many, the first in that order; each task sends its own first, so that no task sees all clusters.
    """
    order = F.desc(clone), F.desc("mass"), "cluster_id"
    some = clusters if most is None else clusters.orderBy(*order).limit(most)
    return some.withColumn("rank", F.when(clone, F.row_number().over(Window.orderBy(*order))).otherwise(0).cast("long"))


def ids(occurrences: DataFrame) -> DataFrame:
    """component, cluster_id: 16 hexadecimal digits of the shape and the set of paths, an ordinal where both recur.

    The paths enter by their number and by sums of two hashes each, in any order: no component's paths are
    gathered in one row.
    """
    sums = [F.sum(F.conv(F.substring(F.md5("path"), at, 7), 16, 10).cast("long")).cast("string") for at in (1, 8)]
    source = occurrences.groupBy("component").agg(F.min("shape").alias("shape"), F.concat_ws("|", F.count("*").cast("string"), *sums).alias("paths"))
    ordinal = F.row_number().over(Window.partitionBy("shape", "paths").orderBy("component")) - 1
    text = F.concat_ws("\n", "shape", "paths", F.when(F.col("ordinal") > 0, F.col("ordinal").cast("string")))
    return source.withColumn("ordinal", ordinal).select("component", F.substring(F.sha2(text, 256), 1, 16).alias("cluster_id"))


def weakest(relations: DataFrame) -> DataFrame:
    """(component, kind) -> component, kind: the weakest relation."""
    return relations.groupBy("component").agg(F.min_by("kind", strength(F.col("kind"))).alias("kind"))


def overlap_runs(spans: DataFrame, *group: str) -> DataFrame:
    """Spans with the number of the run of overlapping spans that they stand in; touching is not overlapping."""
    order = Window.partitionBy(*group).orderBy("start", F.desc("end"))
    frontier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("new_", F.when(frontier.isNull() | (F.col("start") >= frontier), 1).otherwise(0)).withColumn("run", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("new_")


def elected(spans: DataFrame, *group: str) -> DataFrame:
    """One representative a run: the widest, ties to the earliest."""
    runs = overlap_runs(spans, *group)
    best = Window.partitionBy(*group, "run").orderBy(F.desc(F.col("end") - F.col("start")), "start")
    return runs.withColumn("n_", F.row_number().over(best)).where("n_ = 1").drop("n_")


def verbatim_families(occurrences: DataFrame) -> DataFrame:
    """(component, file_id, text_hash) -> families of byte-identical members: component, text_hash, copies, first."""
    return occurrences.groupBy("component", "text_hash").agg(F.count("*").alias("copies"), F.min("file_id").alias("first")).where("copies >= 2")


def subsumed(clusters: DataFrame) -> DataFrame:
    """Clusters of one exact file set: all but the preferred one, by occurrences, mass and id.

    cluster_id, file_set, occurrences, mass -> cluster_id, by.
    """
    best = clusters.groupBy("file_set").agg(F.max_by("cluster_id", F.struct("occurrences", "mass", F.col("cluster_id"))).alias("by"))
    return clusters.join(best, "file_set").where("cluster_id <> by").select("cluster_id", "by")


def clone_groups(component: list[int], relation) -> list[tuple[list[int], str]]:
    """Greedy cover of one component: its least uncovered member and all that are clones of it; then what is left for information.

    relation(a, b) gives a kind. A group carries its weakest kind.
    """
    strong = {k: len(KINDS) - i for i, k in enumerate(KINDS)}
    uncovered, groups, seen = sorted(component), [], set()
    while uncovered:
        first = uncovered[0]
        kinds = {m: relation(first, m) for m in component if m != first}
        clones = sorted([first, *(m for m, k in kinds.items() if strong.get(k, 0) > 1)])
        alike = sorted([first, *(m for m, k in kinds.items() if k == "structural_only")])
        if len(clones) >= 2 and tuple(clones) not in seen:
            seen.add(tuple(clones))
            groups.append((clones, min((kinds[m] for m in clones if m != first), key=strong.__getitem__)))
            uncovered = [m for m in uncovered if m not in clones]
        else:
            uncovered = uncovered[1:]
        if len(alike) >= 2 and not any(set(alike) <= set(g) for g, _ in groups):
            groups.append((alike, "structural_only"))
    return groups


def with_severity(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("severity", S.severity(F.col("mass")))


def families(occurrences: DataFrame) -> DataFrame:
    """(component, file_id, shape) -> component, shape, copies: families of one shape, of components that hold two or more such."""
    made = occurrences.groupBy("component", "shape").agg(F.count("*").alias("copies")).where("copies >= 2")
    torn = made.groupBy("component").agg(F.count("*").alias("n_")).where("n_ >= 2").select("component")
    return made.join(torn, "component", "left_semi")


def containers(spans: DataFrame, least: int = 2, share: float = 2 / 3) -> DataFrame:
    """(component, file_id, start, end) -> members that hold `least` others of their component, which cover `share` of them."""
    a, b = spans.alias("a"), spans.alias("b")
    inside = (F.col("a.component") == F.col("b.component")) & (F.col("a.file_id") == F.col("b.file_id")) & S.strictly_encloses(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    held = a.join(b, inside).groupBy("a.component", "a.file_id", "a.start", "a.end").agg(F.count("*").alias("held"), F.sum(F.col("b.end") - F.col("b.start")).alias("covered"))
    return held.where((F.col("held") >= least) & (F.col("covered") >= share * (F.col("end") - F.col("start"))))


def coalesced(views: DataFrame) -> DataFrame:
    """(left_file, right_file, left_start, left_end, shift) -> runs of one shift that overlap or touch, joined into their union.

    A copied run keeps its distance between the two files, so a run's windows share their shift.
    """
    group = ("left_file", "right_file", "shift")
    order = Window.partitionBy(*group).orderBy("left_start", F.desc("left_end"))
    frontier = F.max("left_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = views.withColumn("new_", F.when(frontier.isNull() | (F.col("left_start") > frontier), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*group, "run").agg(F.min("left_start").alias("left_start"), F.max("left_end").alias("left_end"), F.count("*").alias("views")).drop("run")


def visibility(occurrences: DataFrame) -> DataFrame:
    """(component, hidden) -> component, hidden_reason: null where two occurrences or more are seen."""
    told = occurrences.groupBy("component").agg(F.count("*").alias("n_"), F.bool_and("hidden").alias("all_"), F.count_if(~F.col("hidden")).alias("seen_")).where("n_ >= 2")
    return told.select("component", F.when(F.col("all_"), "all_hidden").when(F.col("seen_") < 2, "single_visible").alias("hidden_reason"))

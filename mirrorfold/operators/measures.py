"""Costly measures of pairs: content agreement, renames, tree overlap, holes of a merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorfold.functions import scalars as S

EXACT_NODES, CREDIT_NODES = 768, 3


def on_pairs(files_: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, a, b: the words of either file."""
    w = files_.select("file_id", S.words(F.col("text")).alias("w"))
    return pairs.select("left", "right").join(w.select(F.col("file_id").alias("left"), F.col("w").alias("a")), "left").join(w.select(F.col("file_id").alias("right"), F.col("w").alias("b")), "right")


def agreement(a: Column, b: Column) -> Column:
    """The share of equal positions, or of common keys where the frontiers' lengths differ; 1 for two empty ones."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), S.set_jaccard(a, b)).when(F.size(a) == 0, F.lit(1.0)).otherwise(same / F.size(a))


def rename(a: list[str], b: list[str]) -> tuple[float, bool]:
    """Score and consistency of a renaming between aligned word lists.

    A substitution counts when each side is the other's most frequent partner (ties to the least) and it
    occurs twice; once, it says nothing.
    """
    from collections import Counter

    swaps = Counter((x, y) for x, y in zip(a, b, strict=True) if x != y)
    ahead: dict[str, tuple[int, str]] = {}
    back: dict[str, tuple[int, str]] = {}
    for (x, y), n in sorted(swaps.items()):
        if n > ahead.get(x, (0, ""))[0]:
            ahead[x] = n, y
        if n > back.get(y, (0, ""))[0]:
            back[y] = n, x
    identity = sum(x == y for x, y in zip(a, b, strict=True))
    modal = {(x, y): n for (x, y), n in swaps.items() if ahead[x][1] == y and back[y][1] == x}
    corroborated = sum(n for n in modal.values() if n >= 2)
    constrained = len(a) - sum(n for n in modal.values() if n < 2)
    explained = identity + corroborated
    coverage = explained / constrained if constrained else 1.0
    weight = explained / (explained + 4)
    weight = 1.0 if coverage == 1 and weight >= S.SUPPORT else weight
    return coverage * weight, constrained == explained and corroborated > 0 and identity >= corroborated


def shingle_jaccards(files_: DataFrame, pairs: DataFrame, width: int = 8) -> DataFrame:
    """left, right, shingle_jaccard of the distinct substrings of `width` of the whole texts; a shorter text is one."""

    def cut_up(t: str) -> set[str]:
        return {t[k : k + width] for k in range(max(1, len(t) - width + 1))}

    @F.pandas_udf("double")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(x & y) / len(x | y) for x, y in ((cut_up(p), cut_up(q)) for p, q in zip(a, b, strict=True))], dtype="float64")

    a, b = files_.select(F.col("file_id").alias("left"), F.col("text").alias("a")), files_.select(F.col("file_id").alias("right"), F.col("text").alias("b"))
    return pairs.select("left", "right").join(a, "left").join(b, "right").select("left", "right", F.round(measure("a", "b"), 6).alias("shingle_jaccard"))


def renames(pairs: DataFrame) -> DataFrame:
    """left, right, a, b of equal lengths -> left, right, score, consistent."""

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("consistent", T.BooleanType())]))
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rename(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["score", "consistent"])

    made = pairs.select("left", "right", measure("a", "b").alias("m"))
    return made.select("left", "right", F.round("m.score", 6).alias("score"), "m.consistent")


def tree_distance(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> int:
    """Zhang-Shasha distance of two trees in post-order, a node given as (kind, position of its leftmost leaf)."""
    n, m = len(a), len(b)
    keys = lambda t: sorted({leaf: k for k, (_, leaf) in enumerate(t)}.values())
    dist = [[0] * m for _ in range(n)]
    for i in keys(a):
        for j in keys(b):
            li, lj = a[i][1], b[j][1]
            rows = [[0] * (j - lj + 2) for _ in range(i - li + 2)]
            for x in range(1, i - li + 2):
                rows[x][0] = x
            rows[0] = list(range(j - lj + 2))
            for x in range(1, i - li + 2):
                for y in range(1, j - lj + 2):
                    p, q = li + x - 1, lj + y - 1
                    if a[p][1] == li and b[q][1] == lj:
                        rows[x][y] = min(rows[x - 1][y] + 1, rows[x][y - 1] + 1, rows[x - 1][y - 1] + (a[p][0] != b[q][0]))
                        dist[p][q] = rows[x][y]
                    else:
                        rows[x][y] = min(rows[x - 1][y] + 1, rows[x][y - 1] + 1, rows[a[p][1] - li][b[q][1] - lj] + dist[p][q])
    return dist[n - 1][m - 1]


def leaf_distance(a: list[str], b: list[str]) -> int:
    """tree_distance of two roots over leaves, which is the edit distance of the leaves, by rows."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[low:n], b[low:m]
    number: dict[str, int] = {}
    ids = [number.setdefault(x, len(number)) for x in (*a, *b)]
    x, y, at = ids[: len(a)], np.array(ids[len(a) :], dtype=np.int64), np.arange(len(b) + 1)
    row = at.copy()
    for k, v in enumerate(x):
        below = np.empty_like(row)
        below[0] = k + 1
        below[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != v))
        row = np.minimum.accumulate(below - at) + at
    return int(row[-1])


def credit(a: list[str], b: list[str]) -> float:
    """Order-respecting greedy credit for sequences of equal parts: max(0, 2 * matched - smaller) of the larger."""
    at, matched = 0, 0
    place: dict[str, list[int]] = {}
    for k, x in enumerate(b):
        place.setdefault(x, []).append(k)
    import bisect

    for x in a:
        spots = place.get(x, [])
        k = bisect.bisect_left(spots, at)
        if k < len(spots):
            at, matched = spots[k] + 1, matched + 1
    return max(0, 2 * matched - min(len(a), len(b))) / max(len(a), len(b), 1)


def on_lines(lines_: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, a, b: the line hashes of either file in order."""
    h = lines_.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "hash"))), lambda x: x["hash"]).alias("w"))
    return pairs.select("left", "right").join(h.select(F.col("file_id").alias("left"), F.col("w").alias("a")), "left").join(h.select(F.col("file_id").alias("right"), F.col("w").alias("b")), "right")


def overlaps(pairs: DataFrame) -> DataFrame:
    """left, right, overlap of trees of a root over leaves: exact up to EXACT_NODES, by credit beyond."""

    def one(a: list[str], b: list[str]) -> float:
        if list(a) == list(b):
            return 1.0
        n, m = len(a) + 1, len(b) + 1
        if max(n, m) > EXACT_NODES:
            return credit(a, b)
        return max(0, max(n, m) - leaf_distance(a, b)) / max(n, m)

    @F.pandas_udf("double")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return pairs.select("left", "right", F.round(measure("a", "b"), 6).alias("overlap"))


def holes(members: DataFrame) -> DataFrame:
    """(component, w) of equally long members -> component, pos, fillings where they differ."""
    even = members.groupBy("component").agg(F.countDistinct(F.size("w")).alias("lengths")).where("lengths = 1").select("component")
    each = members.join(even, "component", "left_semi").select("component", F.posexplode("w").alias("pos", "token"))
    return each.groupBy("component", (F.col("pos") + 1).cast("long").alias("pos")).agg(F.countDistinct("token").alias("fillings")).where("fillings > 1")


def operator_surplus(files_: DataFrame, pairs: DataFrame, operators: str = r"[.,;:!?|#*%&$]") -> DataFrame:
    """left, right, substituted: each side has more of some operator than the other, so that one stands for another; more on one side alone is an addition."""
    counts = files_.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(operators), F.lit(0))).alias("op")).groupBy("file_id", "op").agg(F.count("*").alias("n"))
    sides = [pairs.select("left", "right").join(counts.withColumnRenamed("file_id", side), side).select("left", "right", "op", (F.col("n") * by).alias("n")) for side, by in (("left", 1), ("right", -1))]
    gaps = sides[0].unionByName(sides[1]).groupBy("left", "right", "op").agg(F.sum("n").alias("n"))
    told = gaps.groupBy("left", "right").agg((F.bool_or(F.col("n") > 0) & F.bool_or(F.col("n") < 0)).alias("substituted"))
    return pairs.select("left", "right").join(told, ["left", "right"], "left").na.fill(False, ["substituted"])


def multiset_bound(lines_: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, bound: no alignment can share more lines than both files have of each kind, over the larger file's."""
    counts = lines_.groupBy("file_id", "hash").agg(F.count("*").alias("n"))
    sizes = lines_.groupBy("file_id").agg(F.count("*").alias("size"))
    a, b = counts.select(F.col("file_id").alias("left"), "hash", F.col("n").alias("x")), counts.select(F.col("file_id").alias("right"), "hash", F.col("n").alias("y"))
    both = pairs.select("left", "right").join(a, "left").join(b, ["right", "hash"]).groupBy("left", "right").agg(F.sum(F.least("x", "y")).alias("both"))
    both = both.join(sizes.select(F.col("file_id").alias("left"), F.col("size").alias("p")), "left").join(sizes.select(F.col("file_id").alias("right"), F.col("size").alias("q")), "right")
    return both.select("left", "right", F.round(F.col("both") / F.greatest("p", "q"), 6).alias("bound"))

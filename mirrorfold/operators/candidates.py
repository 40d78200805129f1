"""Candidate pairs by three routes, their evidence, and which survive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.functions import scalars as S
from mirrorfold.functions import texts
from mirrorfold.plans.checkpoints import written

BLOCK = 16_384  # vectors of a block in an exact search
MANY = 500_000  # grams that go to every task (about 12 MB); beyond, both sides are dealt


def stars(rows: DataFrame, *key: str, id_: str = "file_id") -> DataFrame:
    """left, right: in each bucket the least id against every other. Linear in the bucket, partial minima."""
    centre = rows.groupBy(*key).agg(F.min(id_).alias("left"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    return rows.join(centre, list(key)).where(F.col(id_) != F.col("left")).select(*key, "left", F.col(id_).alias("right"))


def hash_pairs(files_: DataFrame, text: Column | None = None) -> DataFrame:
    """Equal-hash buckets within a language, as stars."""
    hashed = files_.select("file_id", "language", F.md5(F.col("text") if text is None else text).alias("hash"))
    return stars(hashed, "language", "hash").select("left", "right", "hash")


def band_pairs(bands: DataFrame) -> DataFrame:
    """Bands that collide, as stars; a pair carries the mask of its bands."""
    return stars(bands, "band", "key").groupBy("left", "right").agg(F.bit_or(F.expr("shiftleft(1L, cast(band as int))")).alias("mask"))


def gram_pairs(grams: DataFrame, least: int) -> DataFrame:
    """Star pairs of files that share a rare-enough line or gram, with how many centres they share."""
    return stars(grams, "hash").groupBy("left", "right").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def exact_jaccard(grams: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, common, n_left, n_right, jaccard of the files' distinct grams, by equi-joins on the pair's own grams."""
    distinct = grams.select("file_id", "gram").distinct()
    return measured(distinct, distinct.groupBy("file_id").agg(F.count("*").alias("n")), pairs)


def measured(distinct: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """As exact_jaccard, with the sizes (file_id, n) of the files' sets at hand; of their grams, those that several files hold will do."""
    a, b = distinct.select(F.col("file_id").alias("left"), "gram"), distinct.select(F.col("file_id").alias("right"), "gram")
    common = pairs.select("left", "right").join(a, "left").join(b, ["right", "gram"]).groupBy("left", "right").agg(F.count("*").alias("common"))
    out = pairs.select("left", "right").join(common, ["left", "right"], "left").na.fill(0, ["common"])
    out = out.join(sizes.select(F.col("file_id").alias("left"), F.col("n").alias("n_left")), "left", "left").join(sizes.select(F.col("file_id").alias("right"), F.col("n").alias("n_right")), "right", "left").na.fill(0, ["n_left", "n_right"])
    union = F.col("n_left") + F.col("n_right") - F.col("common")
    return out.withColumn("jaccard", F.when(union == 0, F.lit(1.0)).otherwise(F.round(F.col("common") / union, 6)))


def gram_sets(grams: DataFrame) -> DataFrame:
    """file_id, n, gram_set: a key that files of equal gram sets share. A file's grams meet in one row, as its text does."""
    return grams.groupBy("file_id").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("gram"))), 256).alias("gram_set"))


def several(grams: DataFrame) -> DataFrame:
    """file_id, gram, first: of distinct (file_id, gram) those whose gram several files hold, with the least of these.

    A gram of two files, as most of these are, names both by its least and its greatest; only those of more are looked up.
    """
    centre = written(grams.groupBy("gram").agg(F.min("file_id").alias("first"), F.max("file_id").alias("last_"), F.count("*").alias("n_")).where("n_ > 1"))
    two = centre.where("n_ = 2").select(F.explode(F.array("first", "last_")).alias("file_id"), "gram", "first")
    more = centre.where("n_ > 2").select("gram", "first")
    return two.unionByName(grams.join(F.broadcast(more) if more.count() <= MANY else more, "gram").select("file_id", "gram", "first"))


def roomy(shared: DataFrame, sizes: DataFrame, least: int = 85) -> DataFrame:
    """Of rows of several() those of files so much of which is shared that a partner of `least` percent is possible.

    A pair's common grams are among what each of the two shares. Rounding to six digits decides for a file.
    """
    held = shared.groupBy("file_id").agg(F.count("*").alias("held")).join(sizes.select("file_id", "n"), "file_id")
    return shared.join(held.where(F.round(F.col("held") / F.col("n"), 6) >= least / 100).select("file_id"), "file_id", "left_semi")


def fitting(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """left, right, bound: the star pairs of gram_pairs, and what their Jaccard can't exceed by their sizes and shared grams.

    shared: rows of several(); sizes: file_id, n of all that stand in it.
    """
    told = sizes.select("file_id", "n").join(shared.groupBy("file_id").agg(F.count("*").alias("held")), "file_id")
    side = lambda name: told.select(F.col("file_id").alias(name), F.col("n").alias(f"{name}_n"), F.col("held").alias(f"{name}_held"))
    pairs = shared.where("file_id <> first").select(F.col("first").alias("left"), F.col("file_id").alias("right")).distinct()
    bound = F.least("left_n", "right_n", "left_held", "right_held") / F.greatest("left_n", "right_n")
    return pairs.join(side("left"), "left").join(side("right"), "right").select("left", "right", F.round(bound, 6).alias("bound"))


def copy_recovery(grams: DataFrame, roots: DataFrame, least: int = 85, sets: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """left, right, left_root, right_root, jaccard: the links of `least` percent that components (node, root) leave open.

    Stars miss near copies whose every shared gram also stands in an earlier, alien file. Of its distinct
    grams, rarest first, a file shows so many that any partner of `least` percent must share one; files of
    different components that meet there and are long enough for each other are measured on whole sets.
    Files of equal sets are one component already: the least speaks for all. Grams of a big family are
    common, so they are shown only where a file has little else, and members of one component never meet.
    A gram of one file is the rarest and met by none: it only takes its place, and a file with too few others
    has no partner. sets, shared: gram_sets(grams) and several(grams), where they are at hand.
    """
    sets, shared = gram_sets(grams) if sets is None else sets, several(grams) if shared is None else shared
    one = sets.groupBy("gram_set").agg(F.min("file_id").alias("file_id"), F.min("n").alias("n")).drop("gram_set")
    mine = shared.select("file_id", "gram").join(one, "file_id").withColumn("held", F.count("*").over(Window.partitionBy("file_id"))).where(f"100 * held >= {least} * n")
    ranked = mine.join(mine.groupBy("gram").agg(F.count("*").alias("files")), "gram").withColumn("place", F.col("n") - F.col("held") + F.row_number().over(Window.partitionBy("file_id").orderBy("files", "gram")))
    shown = ranked.where(F.expr(f"files > 1 and place <= n - ceil({least} * n / 100.0) + 1")).join(roots.select(F.col("node").alias("file_id"), "root"), "file_id", "left").withColumn("root", F.coalesce("root", "file_id"))
    side = lambda name: shown.select("gram", F.col("file_id").alias(name), F.col("root").alias(f"{name}_root"), F.col("n").alias(f"{name}_n"))
    fits = F.expr(f"left < right and left_root <> right_root and 100 * least(left_n, right_n) >= {least} * greatest(left_n, right_n)")
    met = side("left").join(side("right"), "gram").where(fits).select("left", "right", "left_root", "right_root").distinct()
    links = measured(shared, sets, met).where(100 * F.col("common") >= least * (F.col("n_left") + F.col("n_right") - F.col("common")))
    return met.join(links.select("left", "right", "jaccard"), ["left", "right"])


def merged(*sources: DataFrame) -> DataFrame:
    """Union of (left, right, structural, token_jaccard, embedding_cos, source): the best of each axis, the sources as bits."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    axes = [F.max(S.finite(F.col(x))).alias(x) for x in ("structural", "token_jaccard", "embedding_cos")]
    return every.groupBy("left", "right").agg(*axes, F.bit_or("source").alias("sources"))


def rescue_eligible(h: Column, j: Column, e: Column, small: Column, large: Column) -> Column:
    weak = (S.fused(h, j, e) < S.FUSED) | ((e == 0) & (j < S.LSH_ONLY))
    return (h == 0) & weak & (j >= S.RESCUE_JACCARD) & (small >= S.RESCUE_NODES) & (small >= large - F.floor(large / 4))


def token_carried(h: Column, j: Column, e: Column, small: Column, large: Column) -> Column:
    return (h == 0) & (e < S.COSINE) & (j >= S.LSH_ONLY) & (S.fused(h, j, e) >= S.FUSED) & (small >= S.RESCUE_NODES) & (small >= S.RESCUE_OVERLAP * large)


def outcome(h: Column, j: Column, e: Column, overlap: Column, small: Column, large: Column) -> Column:
    """What becomes of a pair, by the first rule that decides."""
    h, j, e, overlap = map(S.finite, (h, j, e, overlap))
    rescued = (overlap >= S.RESCUE_OVERLAP) & (j >= S.RESCUE_JACCARD) & (small >= S.RESCUE_NODES)
    return (
        F.when((S.fused(h, j, e) < S.FUSED) & ~rescued, "below_fused")
        .when((h == 0) & (large > S.SIZE_RATIO * small), "size_incoherent")
        .when((h == 0) & (e == 0) & ~rescued & (j < S.LSH_ONLY), "lsh_below_floor")
        .when((h == 0) & (e == 0) & ~rescued & (small < S.LSH_NODES), "lsh_too_small")
        .when(S.fused(h, j, e) < S.FUSED, "kept_shared_subtree").otherwise("kept")
    )


def same_file_valid(windows: DataFrame) -> DataFrame:
    """Star pairs of equal windows of one file that do not overlap."""
    keyed = windows.select("file_id", "hash", "width", "start", "end")
    first = keyed.groupBy("file_id", "hash").agg(F.min(F.struct("start", "end")).alias("c"), F.count("*").alias("n_")).where("n_ > 1")
    return keyed.join(first, ["file_id", "hash"]).where((F.col("start") > F.col("c.start")) & ~S.overlaps(F.col("start"), F.col("end"), F.col("c.start"), F.col("c.end"))).select("file_id", "hash", "width", F.col("c.start").alias("left_start"), F.col("start").alias("right_start"))


def neighbours(vectors: DataFrame, k: int | None = 5, least: float = S.COSINE) -> DataFrame:
    """Exact nearest neighbours: blocks of vectors meet block against block, each keeps its k best; all without k.

    query_id, vec_id, cosine, rank; pairs below `least` are dropped. Vectors of different lengths are not
    compared. The work is quadratic in the vectors: at cosines this low hyperplane buckets must hold most of
    all pairs before they find nine in ten neighbours.
    """
    v = vectors.where(F.size("embedding") > 0).select("vec_id", F.size("embedding").alias("dims"), "embedding").distinct()
    n = max(1, -(-v.count() // BLOCK))
    own, met = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a, b = v.select("*", own.alias("x"), met.alias("y")).groupBy("dims", "x", "y"), v.select("*", met.alias("x"), own.alias("y")).groupBy("dims", "x", "y")

    def unit(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Ids and unit vectors, those of finite ones alone: others have no cosine."""
        m = np.concatenate(f["embedding"].tolist()).astype(np.float64).reshape(len(f), -1)
        m = m / np.where((norm := np.sqrt((m * m).sum(axis=1))) == 0, 1, norm)[:, None]
        finite = np.isfinite(m).all(axis=1)
        return f["vec_id"].to_numpy()[finite], m[finite]

    def rounded(cosine: np.ndarray) -> np.ndarray:
        return np.round(np.clip(cosine, 0, 1), 6)

    def best(query: np.ndarray, others: np.ndarray, ua: np.ndarray, ub: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column, cosine of all that can be among the k best: sifted in single precision, then measured in double.

        Of so many spans of columns as k, each holds one at least as near as the k-th nearest span's best, so that is
        a floor for the k-th best; what single precision and rounding can shift is allowed for.
        """
        near = fa @ fb.T
        own = np.searchsorted(others, query), np.searchsorted(others, query, "right")
        for r in np.nonzero(own[0] < own[1])[0]:
            near[r, own[0][r] : own[1][r]] = -2
        slack = 4e-7 * (fa.shape[1] + 2) + 4e-6
        floor = np.full(len(query), max(least, 0), dtype=np.float64)
        if k and len(others) > 2 * k:
            tops = np.maximum.reduceat(near, np.arange(0, len(others), max(1, len(others) // max(2 * k, 128))), axis=1)
            floor = np.maximum(floor, np.partition(tops, -k, axis=1)[:, -k])
        bound = np.where(floor > slack, floor - slack, -1.5).astype(np.float32)  # at 0 all below tie
        row, col = np.divmod(np.flatnonzero(near >= bound[:, None]), len(others))
        if len(row) > 64 * len(query):  # many alike
            cosine = rounded(ua @ ub.T)[row, col]
        else:
            cosine = rounded(np.einsum("ij,ij->i", ua[row], ub[col]))
        kept = cosine >= max(least, 0)
        return row[kept], col[kept], cosine[kept]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(a) and len(b):
            (ids, ua), (others, ub) = unit(a), unit(b.sort_values("vec_id"))
            fa, fb = ua.astype(np.float32), ub.astype(np.float32)
            for at in range(0, len(ids) if len(others) else 0, 64):
                query = ids[at : at + 64]
                row, col, cosine = best(query, others, ua[at : at + 64], ub, fa[at : at + 64], fb)
                order = np.lexsort((col, -cosine, row))
                row, col, cosine = row[order], col[order], cosine[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < (k or len(others))
                made.append(pd.DataFrame({"query_id": query[row[first]], "vec_id": others[col[first]], "cosine": cosine[first]}))
        return pd.concat(made) if made else pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})

    # dealt by query once, for what is distinct and for the ranks
    pairs = a.cogroup(b).applyInPandas(meet, "query_id long, vec_id long, cosine double").repartition("query_id").distinct()
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")).cast("long")).where(F.col("rank") <= k if k else F.lit(True))


def snippet_fanout(files_: DataFrame) -> DataFrame:
    """Files of equal text share one snippet: snippet, representative, copies."""
    return files_.groupBy(F.md5("text").alias("snippet")).agg(F.min("file_id").alias("representative"), F.count("*").alias("copies"))


def shared_grams(few: DataFrame, many: DataFrame, few_id: str, many_id: str, k: int) -> DataFrame:
    """few_id, many_id, shared: how many distinct k-grams two texts have in common, of those that have any.

    A table of bits of the few texts' grams, of a fixed size, sifts the others' where they are read; what passes
    by chance falls out of the join, which is on whole grams. However many are marked, nothing is lost.
    """
    a = texts.gram_rows(few, few_id, k).distinct()
    b = texts.gram_rows(many, many_id, k, texts.gram_bits(few, few_id, k)).distinct()
    return a.join(b, "gram").groupBy(few_id, many_id).agg(F.count("*").alias("shared"))

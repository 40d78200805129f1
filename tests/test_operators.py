"""The core operators on small frames: each threshold's two sides, ties, empty and odd cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfold.functions import scalars as S
from mirrorfold.operators import admission, candidates, clusters, closure, exclusions, fingerprints, literals, measures, metrics, reports, signatures
from mirrorfold.plans import catalogue
from mirrorfold.streaming import changes


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_fusion_ignores_odd_scores(spark):
    nan = F.lit(float("nan"))
    assert value(spark, S.fused(nan, F.lit(0.4), F.lit(None))) == 0.4
    assert value(spark, S.fused(F.lit(7.0), nan, F.lit(float("inf")))) == 1.0


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, S.cosine(a, a)) == 1.0
    assert value(spark, S.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert value(spark, S.cosine(a, F.array(F.lit(-1.0), F.lit(0.0)))) == 0.0


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2), ("é\r\nü", 2)])
def test_line_count(spark, text, n):
    assert value(spark, S.line_count(F.lit(text))) == n


def test_kgrams_below_k(spark):
    words = lambda n: F.array(*(F.lit(str(k)) for k in range(n)))
    assert [len(value(spark, S.kgrams(words(n)))) for n in (1, 4, 5, 7)] == [0, 0, 1, 3]


def test_intervals(spark):
    at = lambda f, *x: value(spark, f(*map(F.lit, x)))
    assert at(S.overlaps, 0, 5, 4, 9) and not at(S.overlaps, 0, 5, 5, 9)
    assert at(S.partially_overlaps, 0, 5, 4, 9) and not at(S.partially_overlaps, 0, 9, 4, 9)
    assert at(S.strictly_encloses, 0, 9, 0, 8) and not at(S.strictly_encloses, 0, 9, 0, 9)


def outcome(spark, *x):
    return value(spark, candidates.outcome(*(F.lit(v) for v in x)))


@pytest.mark.parametrize(
    ("pair", "want"),
    [
        ((0.0, 0.84, 0.0, 0.0, 50, 50), "below_fused"), ((0.0, 0.84, 0.0, 0.75, 30, 40), "kept_shared_subtree"), ((0.0, 0.64, 0.0, 0.75, 30, 40), "below_fused"), ((0.0, 0.84, 0.0, 0.75, 29, 40), "below_fused"),
        ((0.0, 0.95, 0.0, 0.0, 50, 201), "size_incoherent"), ((0.0, 0.95, 0.0, 0.0, 50, 200), "kept"), ((1.0, 0.0, 0.0, 0.0, 5, 500), "kept"), ((0.0, 0.89, 0.0, 0.0, 50, 50), "lsh_below_floor"),
        ((0.0, 0.90, 0.0, 0.0, 39, 50), "lsh_too_small"), ((0.0, 0.90, 0.0, 0.0, 40, 50), "kept"), ((0.0, 0.1, 0.86, 0.0, 5, 6), "kept"), ((0.0, float("nan"), 0.86, 0.0, 5, 6), "kept"),
    ],
)
def test_outcomes(spark, pair, want):
    assert outcome(spark, *pair) == want


def test_stars_are_linear(spark):
    rows = spark.createDataFrame([(k, "a" if k < 50 else "b" if k < 52 else "c") for k in range(53)], "file_id long, key string")
    got = candidates.stars(rows, "key").collect()
    assert len(got) == 49 + 1 and {r["left"] for r in got} == {0, 50}


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)], [(5, 5)], [(1, 2), (2, 1), (3, 4), (9, 3)], []])
def test_components(spark, edges):
    low = {}
    for u, v in edges:
        low.setdefault(u, u), low.setdefault(v, v)
    for _ in low:
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    got = {r["node"]: r["root"] for r in closure.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_windows(spark):
    files = spark.createDataFrame([(1, "a b\na b\na b\nc d e"), (2, "x"), (3, "")], "file_id long, text string")
    got = fingerprints.sibling_windows(fingerprints.lines(files)).collect()
    assert sorted((r["ordinal"], r["width"], r["nodes"], r["uniform"]) for r in got) == [(0, 2, 6, True), (0, 3, 9, True), (0, 4, 13, False), (1, 2, 6, True), (1, 3, 10, False), (2, 2, 7, False)]


def test_full_signature_is_the_slots_minimum(spark):
    files = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b")], "file_id long, text string")
    full = {r["file_id"]: r["signature"] for r in signatures.full_signatures(files).collect()}
    slots = {(r["file_id"], r["slot"]): r["value"] for r in signatures.by_slots(fingerprints.token_kgrams(files), 16).collect()}
    assert all(full[1][k] == slots[1, k] for k in range(16)) and set(full[2]) == {signatures.EMPTY}


def test_runs_touch_without_meeting(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 6, 7), (1, 8, 12), (2, 0, 1)], "f long, start long, end long")
    got = sorted((r["f"], r["start"], r["end"]) for r in clusters.elected(spans, "f").collect())
    assert got == [(1, 0, 5), (1, 5, 9), (2, 0, 1)]


def test_clone_groups():
    kinds = {(0, 1): "identical", (0, 2): "structural_only", (1, 2): "loosely_similar"}
    relation = lambda a, b: kinds.get((min(a, b), max(a, b)), "none")
    groups = clusters.clone_groups([0, 1, 2], relation)
    assert ([0, 1], "identical") in groups and ([0, 2], "structural_only") in groups


def test_masses_and_ranks(spark):
    o = spark.createDataFrame([(1, 1, 10, False), (1, 2, 12, False), (1, 3, 11, True), (2, 4, 10, False), (2, 5, 10, False), (3, 6, 99, False)], "component long, file_id long, nodes long, hidden boolean")
    got = clusters.ranked(clusters.masses(o).withColumn("cluster_id", F.col("component").cast("string")), F.lit(True)).orderBy("rank").collect()
    assert [(r["component"], r["mass"], r["rank"]) for r in got] == [(1, 10, 1), (2, 10, 2)]


def test_rename():
    a, b = "x = f ( x ) ; y = x".split(), "z = f ( z ) ; y = z".split()
    score, consistent = measures.rename(a, b)
    assert consistent and score > 0.5
    assert not measures.rename(["a", "b"], ["c", "b"])[1] and measures.rename([], [])[0] == 0.0


def test_tree_distance():
    flat = lambda w: [(x, k) for k, x in enumerate(w)] + [("r", 0)]
    assert measures.tree_distance(flat("abc"), flat("abc")) == 0
    assert measures.tree_distance(flat("abc"), flat("axc")) == 1
    assert measures.tree_distance(flat("abc"), flat("bcd")) == 2
    nested = [("a", 0), ("b", 1), ("x", 0), ("r", 0)]
    assert measures.tree_distance(nested, [("a", 0), ("b", 1), ("r", 0)]) == 1


def test_credit():
    assert measures.credit(list("abcd"), list("abcd")) == 1 and measures.credit(list("abcd"), list("wxyz")) == 0


def test_admission(spark):
    verdict = lambda h, s, j, e, a, r: value(spark, admission.content_verdict(*(F.lit(float(x)) for x in (h, s, j, e, a, r)), F.lit(False), F.lit(False)))
    assert verdict(0, 0, 0.94, 0, 0, 0) == "not_required" and verdict(0, 0, 0.95, 0, 0.84, 0) == "content_below_floor" and verdict(0, 0, 0.95, 0, 0.85, 0) == "measured"
    assert verdict(1, 0, 0, 0, 1, 0) == "exact_frontier" and verdict(1, 0, 0, 0, 0.7, 0) == "measured" and verdict(1, 0, 0, 0.8, 0, 0) == "not_required"
    assert value(spark, admission.text_identity(F.lit("a  b"), F.lit("a\nb"))) == "indentation_only"


def test_folders_keep_clean_files(spark):
    per = spark.createDataFrame([("a/b/x", 10, 5), ("a/y", 10, 0), ("c/z", 4, 0)], "path string, analysed_loc long, duplicated_loc long")
    got = {r["folder"]: (r["analysed_loc"], r["percent"]) for r in metrics.by_folder(per).collect()}
    assert got == {"a": (20, 25.0), "a/b": (10, 50.0)}


def test_thresholds_are_strict(spark):
    assert not value(spark, metrics.breached(F.lit(5.0), F.lit(5.0), F.lit("cli"))) and not value(spark, metrics.breached(F.lit(9.0), F.lit(5.0), F.lit("none")))
    assert value(spark, metrics.breached(F.lit(5.1), F.lit(5.0), F.lit("config")))


def test_spans(spark):
    lines = spark.createDataFrame([("p", x) for x in (1, 2, 3, 7, 8, 3)], "path string, line long")
    assert sorted((r["first"], r["last"]) for r in metrics.spans(lines).collect()) == [(1, 3), (7, 8)]


def test_diff_tags(spark):
    o = spark.createDataFrame([("c", "p", 1, 4, False), ("c", "q", 1, 4, True), ("d", "p", 9, 9, True)], "cluster string, path string, start_line long, end_line long, hidden boolean")
    added = spark.createDataFrame([("p", 4, 9)], "path string, first long, last long")
    got = {r["cluster"]: (r["intersects_diff"], r["is_newly_introduced"]) for r in metrics.diff_tags(o, added).collect()}
    assert got == {"c": (True, False), "d": (False, False)}


def test_page_budget(spark):
    c = spark.createDataFrame([(str(k), k, 7) for k in range(1, 9)], "cluster_id string, rank long, copies long")
    assert [(r["rank"], r["shown"]) for r in reports.page(c, offset=1).orderBy("rank").collect()] == [(2, 7), (3, 7), (4, 1)]


def test_filters(spark):
    c = spark.createDataFrame([("a", "identical", "high", 2), ("b", "same_behavior", "low", 5)], "cluster_id string, kind string, severity string, copies long")
    o = spark.createDataFrame([("a", "src/x", "en"), ("b", "lib/y", "de")], "cluster_id string, path string, language string")
    ids = lambda **k: {r["cluster_id"] for r in reports.filtered(c, o, **k).collect()}
    assert ids() == {"a", "b"} and ids(kinds=[]) == set() and ids(languages=[]) == {"a", "b"} and ids(path="lib") == {"b"} and ids(min_size=3) == {"b"} and ids(kinds=["identical"], severities=["low"]) == set()
    with pytest.raises(ValueError):
        reports.by_prefix(c, "abc")


def test_delta(spark):
    one, two = (spark.createDataFrame(x, "cluster_id string, mass long") for x in ([("a", 1), ("b", 2), ("c", None)], [("b", 3), ("c", None), ("d", 1)]))
    assert {(r["cluster_id"], r["change"]) for r in reports.delta(one, two).collect()} == {("a", "removed"), ("b", "updated"), ("d", "added")}


def test_literals(spark):
    sites = spark.createDataFrame([("1", 1), ("1", 1), ("1", 2), ("2", 1), ("2", 1), ("2", 1), ("2", 1), *[("3", 1)] * 5], "value string, file_id long")
    assert {r["value"] for r in literals.magic(sites).collect()} == {"1", "3"}


def test_exclusions(spark):
    assert value(spark, exclusions.excluded(F.lit("a/Node_Modules/b"))) and not value(spark, exclusions.excluded(F.lit("a/node_modules/b"), dependencies=True))
    assert value(spark, exclusions.minified(F.lit("a.min.js"), F.lit("x"))) and value(spark, exclusions.minified(F.lit("a.js"), F.lit("x" * 20_000))) and not value(spark, exclusions.minified(F.lit("a.js"), F.lit("x\n" * 20_000)))
    assert value(spark, exclusions.generated(F.lit("\n// Code  GENERATED by x. DO NOT EDIT.\nx"))) and value(spark, exclusions.generated(F.lit("/* @generated */\n"))) and not value(spark, exclusions.generated(F.lit("x\n// @generated")))
    assert not value(spark, exclusions.generated(F.lit("this file is generated by hand, do not edit"))) and not value(spark, exclusions.generated(F.lit("// // @generated")))
    hidden = {"a/Generated/b.py": True, "x/tests/fixtures/y.py": True, "tests/x/fixtures/y": False, "a/b.pb.cs": True, "a/b.cs": False, "": False}
    assert {p: value(spark, exclusions.report_hidden(F.lit(p))) for p in hidden} == hidden
    paths = {"a/../b": True, "a/../../b": False, "/a": False, "..": False, "a/./b": True}
    assert {p: value(spark, exclusions.contained(F.lit(p))) for p in paths} == paths


def test_incremental_equals_cold(spark):
    files = spark.createDataFrame([(k, "en", "abc"[k % 3] if k < 20 else str(k)) for k in range(30)], "file_id long, language string, text string")
    cold = {(r["left"], r["right"]) for r in candidates.hash_pairs(files).collect()}
    got = changes.incremental_pairs(files.where("file_id % 4 <> 1"), files.where("file_id % 4 = 1"))
    assert {(r["left"], r["right"]) for r in got.collect()} == cold


def test_applied(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    batch = spark.createDataFrame([("a", "9", "upsert"), ("b", None, "delete"), ("c", "3", "upsert")], "path string, text string, op string")
    assert {tuple(r) for r in changes.applied(state, batch).collect()} == {("a", "9"), ("c", "3")}


def test_debounce_stream(spark, tmp_path):
    log = spark.createDataFrame([(0.0, "b"), (0.1, "a"), (0.2, "b"), (9.0, "c"), (60.0, "z")], "s double, path string").select(F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), F.lit("r").alias("root"), "path")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.debounced(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["paths"] for r in spark.table("flushes").collect()) == [["a", "b"], ["c"]]
    assert math.isfinite(len(spark.table("flushes").collect()))


def test_neighbours_are_all_found(spark):
    """Against brute force, with lengths other than 64; a length is compared with itself alone."""
    draw = np.random.default_rng(3)
    vectors = {i: draw.normal(size=16 if i % 3 else 64) for i in range(240)} | {240: np.zeros(64)}
    got = collections.defaultdict(list)
    for r in sorted(candidates.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), least=0.2).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["cosine"]))
    for i, v in vectors.items():
        near = sorted((-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 6), j) for j, w in vectors.items() if j != i and len(w) == len(v) and v.any() and w.any())
        assert got[i] == [(j, -c) for c, j in near[:5] if -c >= 0.2]


def test_leaf_distance_is_the_tree_distance():
    tree = lambda w: [(x, k) for k, x in enumerate(w)] + [("root", 0)]
    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = ([str(x) for x in draw.integers(0, 4, draw.integers(0, 14))] for _ in range(2))
        assert measures.leaf_distance(a, b) == measures.tree_distance(tree(a), tree(b))


def test_overlaps_are_exact_up_to_the_limit(spark):
    """An early line that recurs at the other's end: by credit the rest would be lost."""
    a = [f"l{k}" for k in range(767)]
    pairs = [(1, 2, a[:200], [*a[1:200], a[0]]), (3, 4, a, [*a[1:], a[0]]), (5, 6, a[:9], a[9:18])]
    got = {r["left"]: r["overlap"] for r in measures.overlaps(spark.createDataFrame(pairs, "left long, right long, a array<string>, b array<string>")).collect()}
    assert got == {1: round(199 / 201, 6), 3: round(766 / 768, 6), 5: 0.1}


def test_tree_overlap_measures_every_candidate(spark, tmp_path):
    """Files that share one line only are measured as well."""
    line, other = (" ".join(f"{c}{k}" for k in range(12)) for c in "ab")
    texts = [f"{line}\n{other}", f"{line}\n" + other.replace("b", "c")]
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["tree_overlap"](spark, str(tmp_path)).collect()] == [(0, 1, round(2 / 3, 6))]


def test_bands_of_all_slots(spark, tmp_path):
    """Pairs near a Jaccard of 0.7: four bands of 16 slots lose a third of them, 32 bands of 128 none."""
    texts = []
    for p in range(40):
        words = [f"p{p}w{k}" for k in range(104)]
        texts += [" ".join(words), " ".join([*words[:91], *(f"q{p}w{k}" for k in range(13))])]
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(2 * p, 2 * p + 1) for p in range(40)}
    assert {(r["left"], r["right"]) for r in catalogue.QUERIES["lsh_band_collisions_128"](spark, str(tmp_path)).collect()} == want
    got = {(r["left"], r["right"]): r["estimate"] for r in catalogue.QUERIES["jaccard_estimate_128"](spark, str(tmp_path)).collect()}
    assert set(got) == want and all(abs(x - 87 / 113) < 0.2 for x in got.values())
    assert {(r["left"], r["right"]) for r in catalogue.QUERIES["lsh_band_collisions"](spark, str(tmp_path)).collect()} < want


def test_literal_bound_of_whole_texts(spark, tmp_path):
    """Texts that differ only far behind, and share one line alone."""
    line = " ".join(f"a{k}" for k in range(800))
    texts = [f"{line}\n" + " ".join(f"{c}{k}" for k in range(300)) for c in "bc"]
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    x, y = ({t[k : k + 8] for k in range(len(t) - 7)} for t in texts)
    assert [tuple(r) for r in catalogue.QUERIES["literal_bound"](spark, str(tmp_path)).collect()] == [(0, 1, round(len(x & y) / len(x | y), 6))]


def test_families_and_containers_of_components(spark, tmp_path):
    """Every document counts, whatever its id, and by its real component; against brute force."""
    texts = {k: "\n".join(" ".join(f"g{g}l{n}w{w}" for w in range(12)) for n in range(5)) for g, ids in enumerate([(3, 71, 905), (64, 66), (8,)]) for k in ids}
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    root = {3: 3, 71: 3, 905: 3, 64: 64, 66: 64}
    windows = [r for r in fingerprints.sibling_windows(catalogue._lines(spark, str(tmp_path))).collect() if r["file_id"] in root]
    shapes = collections.Counter((root[r["file_id"]], r["hash"]) for r in windows if r["width"] == 2)
    got = [tuple(r) for r in catalogue.QUERIES["family_split"](spark, str(tmp_path)).select("component", "shape", "copies").collect()]
    assert len(shapes) == 8 and sorted(got) == sorted((c, h, n) for (c, h), n in shapes.items())
    want = set()
    for a in windows:
        inside = [b["end"] - b["start"] for b in windows if b["file_id"] == a["file_id"] and a["start"] <= b["start"] and b["end"] <= a["end"] and (a["start"], a["end"]) != (b["start"], b["end"])]
        if len(inside) >= 2 and 3 * sum(inside) >= 2 * (a["end"] - a["start"]):
            want.add((root[a["file_id"]], a["file_id"], a["start"], a["end"], len(inside), sum(inside)))
    got = catalogue.QUERIES["container_election"](spark, str(tmp_path)).select("component", "file_id", "start", "end", "held", "covered").collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want) and {r["file_id"] for r in got} == set(root)


def test_copy_recovery_leaves_no_link_open(spark):
    rng = np.random.default_rng(5)
    common = [f"c{k}" for k in range(30)]
    sets, k = {}, 100
    for line in common:  # an earlier, alien file for each line
        sets[len(sets)] = {line, f"own{len(sets)}", f"other{len(sets)}"}
    for _ in range(60):
        base = set(rng.choice(common, 20, replace=False))
        sets[k], sets[k + 1], sets[k + 2] = base, base - {min(base)}, set(rng.choice(common, 20, replace=False))
        k += 3
    sets[k] = set(sets[100])
    grams = spark.createDataFrame([(f, g) for f, s in sets.items() for g in s], "file_id long, gram string")
    alike = candidates.stars(candidates.gram_sets(grams), "gram_set")
    first = closure.components(alike.select(F.col("left").alias("u"), F.col("right").alias("v")))
    got = closure.welded(first, candidates.copy_recovery(grams, first))
    want = {f: f for f in sets}
    find = lambda f: f if want[f] == f else find(want[f])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                want[y] = x
    size = collections.Counter(find(f) for f in sets)
    assert {r.node: r.root for r in got.collect()} == {f: find(f) for f in sets if size[find(f)] > 1}
    empty = grams.where("false")
    assert candidates.copy_recovery(empty, first).count() == 0

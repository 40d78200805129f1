"""What the queries must not do on large tables, seen in their plans, and the same results as plain counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfold.operators import candidates, fingerprints, signatures
from mirrorfold.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sentence(seed, n=12):
    draw = random.Random(seed)
    return " ".join(draw.choice("abcdefghijklmnop") for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of documents, and a benchmark; texts of several lines, copies, near copies, an id that occurs twice, empty and null texts."""
    base = [" \n\t".join(sentence(10 * k + j) for j in range(4)) for k in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(20, base[0]), (21, base[1] + " more"), (22, base[2]), (22, sentence(99)), (23, ""), (24, None), (25, "a b c"), (26, base[2]), (27, base[2] + "\n" + sentence(99))]
    spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, base[0]), (2, sentence(21) + "\n" + sentence(99, 13)), (3, "a b"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def grams(text, k):
    w = (text or "").split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("name", ["jaccard_estimate_128", "lsh_band_collisions_128", "jaccard_estimate"])
def test_signatures_are_worked_out_once(spark, folder, name):
    told = plan(catalogue.QUERIES[name](spark, folder[0]))
    assert "regexp" not in told and "MapIn" not in told


@pytest.mark.parametrize(("name", "slots"), [("jaccard_estimate_128", 128), ("jaccard_estimate", 16)])
def test_estimates_of_an_id_with_two_texts(spark, folder, name, slots):
    from hashlib import md5

    sets = {}
    for i, t in folder[1]:
        sets.setdefault(i, set()).update(int(md5(g.encode()).hexdigest()[:7], 16) for g in grams(t, 5))
    sig = {i: [min((h * (s * 2654435 + 97) + s * 40503 + 11) % 2147483647 for h in x) for s in range(slots)] for i, x in sets.items() if x}
    want, shared = {}, {}
    for b in range(slots // 4):
        for i, x in sig.items():
            shared.setdefault((b, *x[4 * b : 4 * b + 4]), []).append(i)
    for ids in shared.values():
        want |= {(min(ids), i): round(sum(p == q for p, q in zip(sig[min(ids)], sig[i], strict=True)) / slots, 6) for i in ids if i != min(ids)}
    got = {(r["left"], r["right"]): r["estimate"] for r in catalogue.QUERIES[name](spark, folder[0]).collect()}
    assert got == pytest.approx(want, abs=1e-6) and (22, 27) in got


def test_bands_are_rows_of_their_own_slots(spark):
    s = spark.createDataFrame([(1, list(range(8)))], "file_id long, signature array<int>")
    assert [(r["band"], r["key"]) for r in signatures.bands(s, 8, 4).collect()] == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7])]


def test_kgrams_stay_where_their_text_is_read(spark, folder):
    from hashlib import md5

    f = fingerprints.files(spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id <> 22"))
    assert "Generate" not in plan(fingerprints.gram_digests(f)) and "Join" not in plan(fingerprints.gram_digests(f))
    want = {}
    for i, t in folder[1]:
        n, x = want.get(i, (0, set()))
        want[i] = n + max(0, len((t or "").split()) - 4), x | grams(t, 5)
    got = {r["file_id"]: (r["grams"], r["distinct_grams"], r["least"]) for r in catalogue.QUERIES["token_kgrams"](spark, folder[0]).collect()}
    assert got == {i: (n, len(x), min(md5(g.encode()).hexdigest() for g in x)) for i, (n, x) in want.items() if n}


def test_contamination_sifts_before_the_shuffle(spark, folder):
    assert "Generate" not in plan(catalogue.QUERIES["benchmark_contamination"](spark, folder[0]))
    items = {r["item_id"]: grams(r["text"], 13) for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect()}
    docs = {}
    for i, t in folder[1]:
        docs.setdefault(i, set()).update(grams(t, 13))
    got = {(r["item_id"], r["doc_id"]): r["shared"] for r in catalogue.QUERIES["benchmark_contamination"](spark, folder[0]).collect()}
    assert got == {(i, d): len(x & y) for i, x in items.items() for d, y in docs.items() if x & y} and got


def test_contamination_where_every_bit_is_marked(spark, folder, monkeypatch):
    from mirrorfold.functions import texts

    monkeypatch.setattr(texts, "gram_bits", lambda *_: b"\xff" * (texts.BITS // 8))
    want = catalogue.QUERIES["benchmark_contamination"](spark, folder[0]).collect()
    few, many = spark.read.parquet(f"{folder[0]}/benchmark.parquet"), spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert sorted(want) == sorted(candidates.shared_grams(few, many, "item_id", "doc_id", 13).collect())


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_dealt_by_query_once(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id long, embedding array<double>")
    told = executed(candidates.neighbours(v, least=0.0))
    assert told.count("hashpartitioning(query_id") == 1 and candidates.BLOCK >= 16_384


@pytest.mark.parametrize("least", [0.0, 0.2])
def test_sifted_neighbours_keep_ties(spark, least):
    """Many alike, opposite, zero and non-finite vectors, ties at 0 and at 1 to the least id."""
    draw = np.random.default_rng(11)
    v = {i: draw.normal(size=8) for i in range(300)} | {i: np.ones(8) for i in range(300, 420)} | {420: np.zeros(8), 421: -np.ones(8), 422: np.full(8, np.nan), 423: np.full(8, np.inf)}
    got = {}
    for r in candidates.neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>"), least=least).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["cosine"]))
    fine = {i: x / (np.linalg.norm(x) or 1) for i, x in v.items() if np.isfinite(x).all()}
    for i, x in fine.items():
        near = sorted((-round(min(1.0, max(0.0, float(x @ y))), 6), j) for j, y in fine.items() if j != i)[:5]
        assert sorted(got.pop(i, [])) == [(k + 1, j, -c) for k, (c, j) in enumerate(near) if -c >= least]
    assert not got


@pytest.fixture
def linked(spark, tmp_path):
    """Documents of families: copies, near copies of equal and of uneven length, alone; with vectors."""
    line = lambda k: " ".join(f"w{k}x{j}" for j in range(9))
    base = [[line(100 * k + j) for j in range(12)] for k in range(4)]
    rows = [(k, "\n".join(b)) for k, b in enumerate(base)] + [(10, "\n".join(base[0])), (11, "\n".join([*base[1][:11], line(900)])), (12, "\n".join(base[1])), (13, "\n".join([*base[2], line(901)])), (14, ""), (15, None), (16, "\n")]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 2.0]) for i in (1, 11)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), dict(rows)


ON_COMPONENTS = ["merge_holes", "existing_places", "metrics_repo", "kind_fold", "metrics_kind", "report_delta", "occurrence_budget", "page_window", "cluster_visibility", "component_members", "metrics_folder", "threshold_verdict"]


@pytest.mark.parametrize("name", ON_COMPONENTS)
def test_components_read_each_text_once(spark, linked, monkeypatch, name):
    from mirrorfold.functions import texts

    called, facts = [], texts.facts
    monkeypatch.setattr(texts, "facts", lambda *a: called.append(a) or facts(*a))
    told = plan(catalogue.QUERIES[name](spark, linked[0]))
    assert len(called) == 1 and "regexp" not in told and "MapIn" not in told


@pytest.mark.parametrize("few", [0, 100_000])
def test_holes_of_even_members(spark, linked, monkeypatch, few):
    monkeypatch.setattr(catalogue, "FEW", few)
    a, b = (linked[1][i].split(" ") for i in (1, 11))
    want = {(1, k + 1, 2) for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y}
    assert {(r["component"], r["pos"], r["fillings"]) for r in catalogue.QUERIES["merge_holes"](spark, linked[0]).collect()} == want and want


def test_facts_are_the_column_functions(spark):
    from mirrorfold.functions import scalars as S
    from mirrorfold.functions import texts

    rows = ["", None, "\n", "a b\tc d e f g\nx", "a\x0bb c\x0cd e f g h i\r\n\n", "ä ö\u00a0ü é è ê ë ì\n" * 2, "  a  b "]
    f = spark.createDataFrame([(i, "p", "en", t) for i, t in enumerate(rows)], "file_id long, path string, language string, text string")
    got = {r["file_id"]: (r["h"], r["n"], r["loc"], r["parts"], sorted(r["grams"])) for r in texts.facts(f, 8).collect()}
    lines = {}
    for r in fingerprints.lines(f).where("nodes >= 8").collect():
        lines.setdefault(r["file_id"], set()).add(r["hash"])
    for r in f.select("file_id", F.md5("text").alias("h"), F.size(S.words(F.col("text"))).alias("n"), S.line_count(F.col("text")).alias("loc"), F.size(F.split("text", " ", -1)).alias("parts")).collect():
        assert got[r["file_id"]] == (r["h"], r["n"], r["loc"], r["parts"], sorted(lines.get(r["file_id"], ())))


def test_only_pairs_with_room_for_a_link_are_measured(spark, monkeypatch):
    draw = random.Random(3)
    sets = {k: {f"g{draw.randrange(60)}" for _ in range(draw.randrange(1, 30))} | {f"own{k}-{j}" for j in range(draw.choice((0, 0, 9)))} for k in range(80)}
    sets |= {100 + k: sets[k] | {"one more"} for k in range(80)}
    grams = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s], "file_id long, gram string")
    shared, sizes = candidates.several(grams), candidates.gram_sets(grams)
    files = {g: [k for k in sets if g in sets[k]] for s in sets.values() for g in s}
    assert {(r["file_id"], r["gram"], r["first"]) for r in shared.collect()} == {(k, g, min(x)) for g, x in files.items() if len(x) > 1 for k in x}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for x in files.values() for a in [min(x)] for b in x if a != b}
    bounds = {(r["left"], r["right"]): r["bound"] for r in candidates.fitting(shared, sizes).collect()}
    assert bounds.keys() == jaccard.keys() and all(bounds[p] >= round(j, 6) for p, j in jaccard.items())
    seen, real = [], candidates.measured
    monkeypatch.setattr(candidates, "measured", lambda d, n, pairs: seen.extend(tuple(r) for r in pairs.select("left", "right").collect()) or real(d, n, pairs))
    monkeypatch.setattr(catalogue, "_table", lambda *_: spark.createDataFrame([(3, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    got = {tuple(r) for r in catalogue._linked(spark, "", sizes, shared).collect()}
    assert got - {(3, 4)} == {p for p, j in jaccard.items() if round(j, 6) >= 0.85} and len(set(seen)) < len(jaccard) / 2


def linked_by_hand(rows, least=8):
    """Roots of the files that equal texts and line Jaccard 0.85 link; texts of one id are one file."""
    from hashlib import md5

    sets, whole = {}, {}
    for i, t in rows:
        sets.setdefault(i, set()).update(md5(x.encode()).hexdigest() for x in (t or "").split("\n") if len(x.split()) + 1 >= least)
        if (t or "").split():
            whole.setdefault(i, set()).add(t)
    root = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and (whole.get(i, set()) & whole.get(j, set()) or 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) > 0)]
    for _ in root:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return {i: root[i] for pair in linked for i in pair}


@pytest.mark.parametrize(("again", "many"), [(False, 500_000), (False, 0), (True, 0)])
def test_sets_of_lines_are_told_where_their_text_is_read(spark, tmp_path, monkeypatch, again, many):
    draw = random.Random(5)
    line = lambda k: " ".join(f"w{k}x{j}" for j in range(9))
    rows = [(k, "\n".join(line(draw.randrange(30)) for _ in range(draw.randrange(1, 12)))) for k in range(20)]
    rows += [(30 + k, t if k % 3 else t + "\n" + line(100 + k) if k % 2 else line(99) + "\n" + t) for k, (_, t) in enumerate(rows)]
    rows += [(60, "too short"), (61, "too short"), (62, ""), (63, None), (64, "\n"), (65, "")] + ([(30, line(7)), (61, line(8)), (66, line(8)), (0, line(200))] if again else [])
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    called, sets = [], candidates.gram_sets
    monkeypatch.setattr(candidates, "gram_sets", lambda g: called.append(g) or sets(g))
    monkeypatch.setattr(candidates, "MANY", many)
    got = {r["node"]: r["root"] for r in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == linked_by_hand(rows) and len(got) > 20 and bool(called) == again


def test_files_without_room_for_a_partner_are_left_out(spark):
    sets = {1: {"a", "b", "c", "d", "e", "f"}, 2: {"a", "b", "c", "d", "e", "f", "own"}, 3: {"a", "x", "y"}, 4: {"z"}}
    grams = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s], "file_id long, gram string")
    roomy = candidates.roomy(candidates.several(grams), candidates.gram_sets(grams)).collect()
    assert {(r["file_id"], r["gram"], r["first"]) for r in roomy} == {(k, g, 1) for k in (1, 2) for g in "abcdef"}


@pytest.mark.parametrize("name, most", [("occurrence_budget", 20), ("page_window", 7), ("cluster_visibility", None)])
def test_no_task_ranks_all_clusters(spark, linked, name, most):
    told = plan(catalogue.QUERIES[name](spark, linked[0])).split("\n")
    at = [k for k, x in enumerate(told) if "Window [row_number()" in x and " mass#" in x]
    assert len(at) == (most is not None)
    for k in at:
        assert f"GlobalLimit {most}" in "".join(told[k + 1 : k + 3])


def test_first_clusters_have_the_ranks_of_all(spark):
    from mirrorfold.operators import clusters

    draw = random.Random(4)
    rows = [(f"{draw.randrange(16**6):06x}", draw.randrange(5), k % 9 > 0) for k in range(300)]
    made = spark.createDataFrame(rows, "cluster_id string, mass long, clone boolean").repartition(7)
    whole = {tuple(r) for r in clusters.ranked(made, F.col("clone")).collect()}
    for most in (1, 20, 290, 400):
        got = [tuple(r) for r in clusters.ranked(made, F.col("clone"), most).collect()]
        assert len(got) == min(most, 300) and set(got) <= whole
        assert sorted(r[3] for r in got if r[2]) == list(range(1, min(most, sum(x[2] for x in rows)) + 1))


def test_clusters_of_the_first_ranks_are_those_of_all(spark, linked):
    rows = {name: [tuple(r) for r in catalogue.QUERIES[name](spark, linked[0]).collect()] for name in ("cluster_mass_rank", "occurrence_budget", "page_window", "cluster_visibility")}
    ranked, spent = sorted(rows["cluster_mass_rank"], key=lambda r: r[6]), 0
    assert len(ranked) >= 3
    want = [(r[0], r[6], spent := spent + r[3]) for r in ranked]
    assert sorted(rows["occurrence_budget"], key=lambda r: r[1]) == [x for x in want if x[2] <= 40]
    assert sorted(r[:3] for r in rows["page_window"]) == sorted((r[0], r[6], r[3]) for r in ranked[2:7])
    assert sorted(r[0] for r in rows["cluster_visibility"]) == sorted(r[0] for r in ranked)

"""Near duplicates, mixing, search, toxicity, surrogates, the language model: against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from mirrorfold.llm import hmm, mixing, neardup, pii, shingles, topk, toxicity
from mirrorfold.llm.common import BATCH, cut, remainder

WORDS = [f"w{k}" for k in range(60)]


def shingled(text, width):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("own", ["64m", "1m"])
def test_cut_bounds_arrow_batches(spark, own):
    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        wide = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 8192) AS x")
        made = cut(wide.mapInArrow(sizes, "bytes long, rows long")).collect()
        assert spark.conf.get(name) == own
    finally:
        spark.conf.set(name, before)
    assert sum(r.rows for r in made) == 3000 and max(r.bytes for r in made) < 1.2 * min(BATCH, int(own[:-1]) << 20)


def near_corpus():
    draw, rows = random.Random(5), []
    for family in range(6):
        base = [draw.choice(WORDS) for _ in range(60)]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(60)] = draw.choice(WORDS)
            rows.append((len(rows) * 3, (" " if family % 2 else "\n").join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "One\x0btwo"), (None, rows[0][1]), (0, rows[0][1]), (1007, "long " * 30_000)]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(spark, width):
    rows = near_corpus()
    got = neardup.groups(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, node string"), width)
    sets = [shingled(t, width) for _, t in rows]
    low = {i: i for i, _ in rows}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for (i, a), (j, b) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        if 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
            low[max(root(i), root(j))] = min(root(i), root(j))
    want = collections.Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets))
    assert collections.Counter(map(tuple, got.collect())) == want


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (3, None, None), (None, None, None), (4, "g h i j k l", "p"), (4, "m n o p q r", "q"), (4, "m n o p q r", "s")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, row_ int, id_ int")
    got = neardup.keep_one(docs)
    kept = sorted(repr(tuple(r)[:2]) for r in got.collect())
    assert got.columns == docs.columns and kept == sorted(map(repr, [(1, "a b c d e f"), (3, None), (None, None), (4, "g h i j k l"), (4, "m n o p q r")]))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, neardup.keep_one(docs.repartition(3)).collect()))
    assert neardup.keep_one(docs.where("doc_id = 9")).count() == 0


def test_shingle_sets():
    texts = [None, b"", b"A b  c\nA B", b"x", "é ñ é ñ".encode(), b"q " * 1000]
    for width in (1, 2, 5):
        assert [len(h) for h in shingles.shingle_sets(texts, width)] == [len(shingled(t.decode() if t else t, width)) for t in texts]


def test_blocks_find_links_a_star_misses(spark):
    """A chain of sets, each linked with the next alone."""
    words = [f"c{k}" for k in range(200)]
    rows = [(100 - k, " ".join(words[8 * k : 8 * k + 100])) for k in range(8)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {93}


def test_mix(spark):
    draw = random.Random(2)
    rows = [(k, "w " * draw.randrange(40), f"s{draw.choice('aaaab')}{k % 3}" if k % 11 else None, k) for k in range(300)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None, None)], "doc_id long, text string, source string, target long")
    got = mixing.mix(docs).collect()
    rerun = mixing.mix(docs.repartition(3)).collect()
    assert len(got) == 302 and sorted(map(repr, got)) == sorted(map(repr, rerun))
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
    total = sum(r["size"] for r in got)
    assert abs(sum(r["target"] for r in {r["source"]: r for r in got}.values()) - 1.5 * total) < 1e-6 * total
    for r in by.values():
        assert abs(sum(x["taken"] for x in r) - r[0]["target"]) <= 3 * max(x["size"] for x in r) + 1
        assert r[0]["target"] <= 2 * r[0]["source_size"] + 1e-6
    assert mixing.mix(docs.where("doc_id = -1")).count() == 0
    clashing = docs.withColumn("size_", mixing.F.lit(77)).withColumn("times", mixing.F.lit("t")).withColumn("row_", mixing.F.lit(5))
    many = mixing.repeated(clashing)
    assert many.columns == clashing.columns and many.count() == sum(r["times"] for r in got)
    assert {(r["size_"], r["times"], r["row_"]) for r in many.collect()} == {(77, "t", 5)}
    long = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(long).collect()} == {1: 300_000, 2: 1}


def test_search(spark):
    draw = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in draw.normal(0, 0.2, 64)]) for k in range(260)]
    vectors[7] = (7, vectors[8][1])
    rows = [*vectors, (900, None), (1000, [float("nan")] * 64), (1100, [None] * 64), (None, vectors[0][1]), (1200, [0.5, 0.25]), (100, vectors[100][1])]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, embedding array<float>, query_id string, floor double")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(frame, topk.F.col("vec_id") % 100 == 0).collect()}
    ints = {k: np.floor(1024 * np.array(v, np.float32).astype(float)) for k, v in vectors}
    for q in (0, 100, 200):
        every = [(k, int(ints[q] @ ints[k])) for k, *_ in [*vectors, (100,)] if k != q]
        best = sorted(every, key=lambda x: (-x[1], x[0]))[:10]
        assert [got[q, k + 1] for k in range(10)] == best
    assert {q for q, _ in got} == {0, 100, 200}
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), topk.F.col("vec_id") % 100 == 0).count() == 0


def test_search_bounds_exclude_pairs(spark):
    """Vectors of a few directions: most pairs fall to their segments' bounds, and none that counts."""
    draw = np.random.default_rng(5)
    heads = draw.normal(0, 1, (8, 16)).repeat(4, axis=1) / 8
    vectors = [(k, (heads[k % 8] + draw.normal(0, 0.01, 64)).astype(np.float32).tolist()) for k in range(1200)]
    frame, query = spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), topk.F.col("vec_id") % 100 == 0
    assert 0 < topk.survivor_share(frame, query) < 0.2
    ints = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(frame, query).collect()}
    for q in range(0, 1200, 100):
        every = sorted(((k, int(ints[q] @ ints[k])) for k in range(1200) if k != q), key=lambda x: (-x[1], x[0]))[:10]
        assert [got[q, k + 1] for k in range(10)] == every


def test_toxicity_fit_against_a_dense_one():
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 300, draw.integers(0, 60))).astype(np.int32) for _ in range(80)]
    y = np.array([k % 3 == 0 for k in range(80)], int)
    x = np.zeros((80, 1 << toxicity.BITS), np.float32)
    for k, r in enumerate(rows):
        x[k, r] = 1
    x = x[:, :300].astype(float)
    bad, good = x[y == 1].sum(0), x[y == 0].sum(0)
    # n-grams that no text has count in the sums' smoothing alone, which both sides share
    ratio = np.log((bad + 10 * bad.sum() / good.sum()) / bad.sum()) - np.log((good + 10) / good.sum())
    empty = np.log(10 * bad.sum() / good.sum() / bad.sum()) - np.log(10 / good.sum())
    w, v, bias, vb = np.zeros(300), np.zeros(300), np.log(y.mean() / (1 - y.mean())), 0.0
    rate = 2.0 * 80 / (x.sum(0) * ratio**2).sum()
    for _ in range(20):
        gap = 1 / (1 + np.exp(-np.clip(x @ (w * ratio) + bias, -30, 30))) - y
        v, vb = 0.9 * v - rate / 80 * ratio * (x.T @ gap), 0.9 * vb - 0.05 * gap.mean()
        w, bias = w + v, bias + vb
    old, toxicity.AT_ONCE = toxicity.AT_ONCE, 100
    try:
        weights, b = toxicity.fitted(rows, y, steps=20)
    finally:
        toxicity.AT_ONCE = old
    assert np.isfinite(empty) and np.allclose(weights[:300], w * ratio) and np.isclose(b, bias) and not weights[300:].any()


def test_ngrams_against_plain_ones():
    from zlib import crc32

    def plain(text):
        found = set()
        for word in set(text.lower().split()):
            w = word.encode().strip(toxicity.STRIP)
            if w:
                w = b"\x02" + w + b"\x03"
                found |= {(h ^ h >> 18) & (1 << 18) - 1 for n in toxicity.GRAMS for k in range(len(w) - n + 1) for h in (crc32(w[k : k + n]),)}
        return found

    of = toxicity.Features().of
    for text in ("", "A bad, BAD day!", "né " + "xyz" * 5000, "one two " * 200_000 + "three"):
        assert set(of(text.encode()).tolist()) == plain(text)


def test_toxicity(spark):
    draw, rows, labels = random.Random(9), [], []
    for k in range(400):
        bad = k % 4 == 0
        w = [draw.choice(WORDS) + draw.choice("abcdef") for _ in range(40)] + (["moronic", "scumbag"] if bad else [])
        draw.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad) if k % 50 else None))
    docs = spark.createDataFrame([(*r, 7, 0.5) for r in (*rows, (None, None), (5000, ""), (5001, "w " * 100_000), (5000, ""))], "doc_id long, text string, toxic int, score double")
    told = spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, told).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in got)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 400 and r["doc_id"] is not None]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    clean = toxicity.keep_clean(docs, told)
    assert clean.columns == docs.columns and clean.count() == sum(not r["predicted"] for r in got) and {(r["toxic"], r["score"]) for r in clean.collect()} == {(7, 0.5)}
    assert toxicity.scored(docs.where("doc_id = -1"), told).count() == 0


KEY = "of the tests"


def surrogates(spark, texts, key=KEY, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.with_surrogates(docs, key, **more).orderBy("doc_id").collect()]


def test_surrogates(spark):
    rows = [
        (1, "mail Anna.Berg12@Firm.co.uk or anna.berg12@firm.co.uk now"), (2, "call +1 (521) 555-2373, or +15215552373."), (3, "card 4111 1111 1111 1111 and 4111111111111111"),
        (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" at 97.51.17.173.'), (5, "Frau Müller und Mr. John Smith, Госпожа Анна Петрова"), (6, None), (7, ""), (8, "clean v1.2.3 on 2024-01-01 at 12:30:45 = ok"), (None, "a@b.de"), (9, "x " * 100_000), (7, ""), (None, "a@b.de"),
    ]
    docs = spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, kind string, pieces int, found int, put int, row int, n_entities int")
    made = pii.with_surrogates(docs, KEY)
    assert made.columns == [*docs.columns, "n_entities_"]
    every = made.collect()
    assert len(every) == len(rows) and {tuple(r)[2:8] for r in every} == {("k", 1, 2, 3, 4, 5)}
    got = {r["doc_id"]: r for r in every}
    for i in (6, 7, 8, 9):
        assert got[i]["text"] == dict(rows)[i] and got[i]["n_entities_"] == 0
    one, two = re.findall(r"\S+@\S+", got[1]["text"])
    assert one.lower() == two.lower() != "anna.berg12@firm.co.uk" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{3}\d\d@[A-Z][a-z]{3}\.[a-z]{2}\.uk", one)
    assert re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), or \+1\d{10}\.", got[2]["text"]) and len({re.sub(r"\D", "", x) for x in re.findall(r"\+[\d ()-]+\d", got[2]["text"])}) == 1
    cards = re.findall(r"\d[\d ]{14,18}", got[3]["text"])
    digits = [int(x) for x in re.sub(" ", "", cards[0])]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0 and len({re.sub(" ", "", c) for c in cards}) == 1
    assert re.fullmatch(r'token = "[0-9a-f]{40}" at \d\d\.\d\d\.\d\d\.\d{3}\.', got[4]["text"]) and "97.51" not in got[4]["text"]
    assert re.fullmatch(r"Frau \w+ und Mr\. \w+ \w+, Госпожа [А-я]+ [А-я]+а", got[5]["text"]) and "Müller" not in got[5]["text"]
    assert pii.with_surrogates(docs.where("doc_id = 99"), KEY).count() == 0
    with pytest.raises(ValueError):
        pii.with_surrogates(docs, "")


def test_surrogates_leave_nothing_of_long_entities(spark):
    texts = ["token: " + "aZ9" * 66 + "b", "password=abc.def-" + "x" * 150 + ".tail9", f"from {'a' * 100}@host.example.org now", "sum " + "0123456789abcdef" * 10 + ".", "at 2001:0db8:85a3:0000:0000:8a2e:0370:7334, fe80::1", "secret: " + "q." * 20_000 + "end", "x" * 300_000 + "@" + "b." * 20_000 + "de"]
    got = surrogates(spark, texts)
    for was, now in zip(texts[:4], got[:4], strict=True):
        assert len(was) == len(now) and not set(re.findall(r"\w{6,}", was)) & set(re.findall(r"\w{6,}", now)) - {"password"}
        assert not any(was[k : k + 20] in now for k in range(len(was) - 19) if len(set(was[k : k + 20])) > 6)
    assert re.fullmatch(r"at [0-9a-f]{4}(:[0-9a-f]{4}){7}, [a-f]{2}\d\d::\d", got[4]) and "8a2e" not in got[4] and "fe80" not in got[4]
    assert "q.q.q.q.q" not in got[5] and "x" * 20 not in got[6]


def test_surrogates_keep_a_person_one(spark):
    texts = ["Mr John Smith met Dr. Jane Doe. Mr Smith left, John Smith came, Jane Doe's too. Mr. J. Smith", "Ms Smith and Herr Dr. Smith", "John Smith is untitled here", "Frau Anna-Lena Müller-Schmidt"]
    got = surrogates(spark, texts)
    john, smith = re.match(r"Mr (\w+) (\w+) met", got[0]).groups()
    jane, doe = re.search(r"Dr\. (\w+) (\w+)\.", got[0]).groups()
    assert got[0] == f"Mr {john} {smith} met Dr. {jane} {doe}. Mr {smith} left, {john} {smith} came, {jane} {doe}'s too. Mr. J. {smith}"
    assert len({john, smith, jane, doe, "John", "Smith", "Jane", "Doe"}) == 8
    assert got[1] == f"Ms {smith} and Herr Dr. {smith}" and got[2] == texts[2] and re.fullmatch(r"Frau \w+ \w+", got[3])
    other = surrogates(spark, texts, key="another")
    assert other[0] != got[0] and surrogates(spark, texts) == got


def test_surrogates_by_join_as_by_map(spark):
    texts = [f"from {chr(97 + k)}@x.de to {chr(122 - k)}@x.de" for k in range(26)] + ["plain", None]
    assert surrogates(spark, texts, handed=0) == surrogates(spark, texts)


def test_surrogates_where_a_text_holds_the_mark(spark):
    text = f"a{pii.MARK}b x@y.de {pii.MARK}"
    now = surrogates(spark, [text])[0]
    assert re.fullmatch(f"a{pii.MARK}b [a-z]@[a-z].de {pii.MARK}", now) and now != text


def test_surrogates_stay_distinct(spark):
    """So few forms that first draws must meet."""
    got = surrogates(spark, [f"from {chr(97 + k)}@x.de" for k in range(26)])
    assert len({re.search(r"\S+@", t).group() for t in got}) == 26 and not {t.split()[1] for t in got} & {f"{chr(97 + k)}@x.de" for k in range(26)}


def test_surrogates_stay_distinct_where_their_form_has_few(spark):
    """More names of one part than three syllables give, short addresses, and a secret without letters."""
    names = ["".join(chr(97 + k // 26**p % 26) for p in range(3)).capitalize() + "x" for k in range(6_000)]
    real = [f"{'Mr' if k % 2 else 'Frau'} {n}" for k, n in enumerate(names)] + [f"{k // 1000}.{k // 100 % 10}.{k // 10 % 10}.{k % 10}" for k in range(6_000)] + ["password: ________"]
    got = [x.removeprefix("to ").removesuffix(" now") for x in surrogates(spark, [f"to {x} now" for x in real])]
    # a person's surrogate is the name alone: people of either title must not share one
    bare = [x.split(" ", 1)[-1] for x in got]
    assert len(set(bare)) == len(real) and not set(bare) & {x.split(" ", 1)[-1] for x in real}
    assert all(re.fullmatch(r"(Mr|Frau) [A-Z][a-z]{1,30}", x) for x in got[:6_000])
    assert all(re.fullmatch(r"\d+(\.\d+){3}", x) and all(int(o) < 256 for o in x.split(".")) for x in got[6_000:12_000])


def test_forward_is_exact():
    draw = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm.Model(norm(draw.random(3)), norm(draw.random((3, 3))), norm(draw.random((3, 5))))
    seqs = [draw.integers(0, 5, n).astype(np.uint16) for n in (6, 4, 4, 1)]
    firsts = np.cumsum([0, *map(len, seqs[:-1])])
    want = [np.log(sum(model.start[p[0]] * model.emits[p[0], s[0]] * np.prod([model.moves[a, b] * model.emits[b, o] for a, b, o in zip(p, p[1:], s[1:])]) for p in itertools.product(range(3), repeat=len(s)))) for s in seqs]
    assert np.allclose(model.forward(np.concatenate(seqs), firsts, np.array(list(map(len, seqs)))), want)
    into = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))]
    model.gather(np.concatenate(seqs), firsts, np.array(list(map(len, seqs))), into)
    assert np.isclose(into[0].sum(), 4) and np.isclose(into[1].sum(), 11) and np.isclose(into[2].sum(), 15)
    again = hmm.Model(norm(into[0]), norm(into[1]), norm(into[2]))
    assert again.forward(np.concatenate(seqs), firsts, np.array(list(map(len, seqs)))).sum() > sum(want)


def test_language_model(spark):
    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice(WORDS[:20] if k % 2 else WORDS[20:40]) for _ in range(30))) for k in range(200)] + [(1000, None), (1001, ""), (None, "W1 w1"), (1002, "never seen " * 3), (5, "w1 w2"), (1003, "w3 " * 20_000)]
    got = collections.defaultdict(list)
    for r in hmm.scored(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, c int, chunk string")).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    counts = collections.Counter()
    tokens = lambda t: [*(t or "").lower().split(), ""]
    for i, t in rows:
        if remainder(i, 10):
            counts.update(tokens(t))
    n, v, better = sum(counts.values()), len(counts), []
    for i, t in rows:
        r = got[i, len(tokens(t))][0]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        assert r["train_tokens"] == n and r["n_known"] == sum(counts[w] > 0 for w in tokens(t)) and np.isclose(r["base_score"], base) and r["held_out"] == (remainder(i, 10) == 0)
        if r["held_out"] and i is not None and i < 200:
            better.append(r["score"] - r["base_score"])
    assert np.mean(better) > 0
    assert hmm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recursions_look_up_a_batch_at_once():
    class Counted(np.ndarray):
        asked = 0

        def __getitem__(self, at):
            Counted.asked += 1
            return super().__getitem__(at)

    lengths = np.array([300, 7, 7, 1])
    firsts, kinds = np.cumsum(lengths) - lengths, np.random.default_rng(5).integers(0, 9, lengths.sum()).astype(np.uint16)
    model, into = hmm.Model.first(np.full(9, 1 / 9)), [np.zeros(4), np.zeros((4, 4)), np.zeros((4, 9))]
    model.gather(kinds.view(Counted), firsts, lengths, into)
    assert Counted.asked < 10
    assert into[0].sum() == pytest.approx(4) and into[1].sum() == pytest.approx(lengths.sum() - 4) and into[2].sum(axis=0) == pytest.approx(np.bincount(kinds, minlength=9))


def test_language_model_reads_bounded_batches(spark, monkeypatch):
    seen, over, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), hmm.chunks

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            over.add(b.nbytes > 1.2 * BATCH)
            yield b

    monkeypatch.setattr(hmm, "chunks", lambda docs, modulus: real(docs.mapInArrow(watch, docs.schema), modulus))
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 12000) AS text")
    made = hmm.scored(docs, rounds=1)
    assert made.agg({"n_tokens": "sum"}).first()[0] == 400 * 12_001
    assert seen.value == 400 and over.value == 0

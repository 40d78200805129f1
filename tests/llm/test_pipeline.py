"""The five stages, each on hard rows, and the whole run."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

TEXTS = ["one two three four five six seven", "ONE two three four five six seven", None, "", "  ", "mail to anna@firm.de or call +1 521 555 2373 today please", "word " * 50_000, "x" * 5_000]
LABELS = [(k, int(k % 8 == 0)) for k in range(80)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows += [rows[0], (3, "another text of the id three that is long enough", "de", "s0", 48), (None, "a text without an id", None, None, 20), (None, "a text without an id", None, None, 20)]
    rows += [(100 + k, ("you are a moronic scumbag and a fool " if toxic else "the weather of the day is nice and mild ") + f"number{k} " * 3, "en", "s1", 60) for k, toxic in LABELS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, t) for k, t in LABELS], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_hard_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name in ("pieces", "found", "put", "size_", "row_", "n_entities"):
        docs = docs.withColumn(name, corpus_pipeline.F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tables)
        rows = made.collect()
        if name != "packing":
            assert made.columns == list(corpus_pipeline.COLUMNS)
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
        none = stage(spark, docs.limit(0), tables)
        assert none.count() == 0 and none.columns == made.columns


def test_run_against_its_parts(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, tables)
    toxic = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    assert {i for i in toxic if i and i >= 100} == {100 + k for k, t in LABELS if t}
    one = corpus_pipeline.near_dedup(spark, clean, tables).collect()
    ids = [r["doc_id"] for r in one]
    assert 0 in ids and 1 not in ids and ids.count(0) == 1 and ids.count(3) == 2 and ids.count(None) == 2
    assert all("anna@firm.de" not in (r["text"] or "") for r in corpus_pipeline.pii(spark, docs, tables).collect())
    packed = corpus_pipeline.run(spark, tables).collect()
    assert packed and {r["doc_id"] for r in packed} <= set(ids)
    places = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 2048

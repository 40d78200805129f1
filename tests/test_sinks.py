import json

from mirrorfold.operators import sinks


def test_sinks(spark):
    c = spark.createDataFrame([("a", "identical", 9, 1), ("b", "same_behavior", 3, 2)], "cluster_id string, kind string, mass long, rank long")
    o = spark.createDataFrame([("a", "q<", 4), ("a", "p", 1)], "cluster_id string, path string, start_line long")
    report = sinks.nested(c, o)
    rows = [json.loads(r["value"]) for r in sinks.json_rows(report).collect()]
    assert [x["path"] for x in next(r for r in rows if r["cluster_id"] == "a")["occurrences"]] == ["p", "q<"]
    assert [r["value"] for r in sinks.text_rows(report).collect()] == ["#1 a identical mass=9\n  p:1\n  q<:4", "#2 b same_behavior mass=3"]
    assert sinks.framed(c, "rank", 80).count() == 1 and sinks.framed(c, "rank").count() == 2
    one = next(r.asDict(recursive=True) for r in report.collect() if r["cluster_id"] == "a")
    assert "- `p:1`" in sinks.markdown(one) and "q&lt;" in sinks.page([one])

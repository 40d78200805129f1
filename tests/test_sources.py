"""Ignore rules, diffs, configuration, scans and the Python front end."""

import pytest

from mirrorfold.sources import config, files, pycode, unified_diff
from mirrorfold.sources.ignore import ignored, rules


@pytest.mark.parametrize(
    ("text", "path", "out"),
    [
        ("*.log", "a/b.log", True), ("*.log\n!keep.log", "keep.log", False), ("build/\n!build/x", "build/x", True), ("/top", "top", True), ("/top", "a/top", False), ("a/**/z", "a/b/c/z", True),
        ("a/**/z", "a/z", True), ("x?.py", "xy.py", True), ("x?.py", "x/.py", False), ("# c\n\n[ab].c", "b.c", True), ("[!ab].c", "b.c", False), ("doc/", "doc", False), ("doc/", "doc/a", True),
    ],
)
def test_ignore(text, path, out):
    assert ignored(path, rules(text)) is out


def test_rules_of_a_folder():
    assert ignored("sub/a.x", rules("*.x", "sub")) and not ignored("a.x", rules("*.x", "sub"))


DIFF = "--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n one\n-two\n+2\r\n+three\n"


def test_diff(spark):
    got = unified_diff.parse(DIFF)
    assert [(x.line, x.added, x.text) for x in got] == [(1, False, "one"), (2, True, "2\r"), (3, True, "three")]
    for bad in (DIFF.replace("+1,3", "+1,4"), DIFF.replace("+1,3", "+1,2"), DIFF.replace("@@ -1", "@@ x")):
        with pytest.raises(unified_diff.DiffError):
            unified_diff.parse(bad)
    corpus = spark.createDataFrame([("f", "one\n2\r\nTHREE")], "path string, text string")
    lines = spark.createDataFrame([(x.path, x.line, x.text) for x in got], "path string, line long, text string")
    assert [tuple(r)[:3] for r in unified_diff.disagreements(corpus, lines).collect()] == [("f", 3, "three")]


def test_config():
    c = config.load('[defaults]\nexclude=["x"]\n[language.python]\nexclude=["y"]\n[threshold]\nmax_duplication_percent=5\n[threshold.kinds]\nidentical=1.5\n[tuning.routing]\nsimilar_content=0.6')
    assert c.excludes("python") == ("x", "y") and c.max_percent == 5 and c.kind_percent == {"identical": 1.5} and c.routing["similar_content"] == 0.6
    for bad in ("[threshold]\nodd=1", "[threshold]\nmax_duplication_percent=101", "[threshold.kinds]\nodd=1", "[tuning.routing]\nodd=1", '[total]\ninclude=["odd"]'):
        with pytest.raises(config.ConfigError):
            config.load(bad)


def test_scan(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.txt": b"no", "node_modules/c.js": b"1", "log/d.py": b"2", "e.py": b"\xff\xfe", "f.min.js": b"3"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: (r["language"], r["text"], r["skipped"]) for r in files.scan(spark, str(tmp_path), ignore={"": "log/"}).collect()}
    assert got == {"a.py": ("python", "x = 1\n", None), "node_modules/c.js": ("javascript", None, "excluded"), "e.py": ("python", None, "not_utf8"), "f.min.js": ("javascript", None, "minified")}


def test_trees():
    hashes = lambda s: {n.hash for n in pycode.tree(s) if n.kind == "FunctionDef"}
    one = "def f(a):\n    return a + 1\n"
    assert hashes(one) == hashes("def f(b):\n    return b + 22\n") != hashes("def f(a):\n    return a - 1\n")
    assert all(n.boilerplate for n in pycode.tree("import a") if n.depth)
    n = next(x for x in pycode.tree("é = 1\n" + one) if x.kind == "FunctionDef")
    assert ("é = 1\n" + one).encode()[n.start : n.end].decode() == one.rstrip()


def test_python_fingerprints(spark):
    f = spark.createDataFrame([(1, "import os\ndef f(a):\n    return a + 1\n"), (2, "def g(z):\n    return z + 9"), (3, "def ("), (4, None)], "file_id long, text string")
    got = pycode.fingerprints(f, 5).collect()
    assert {r["file_id"]: r["skipped"] for r in got if r["skipped"]} == {3: "SyntaxError"}
    assert len({r["hash"] for r in got if r["kind"] == "FunctionDef"}) == 1

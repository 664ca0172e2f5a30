"""Reports, selections, merges and batch edits on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import summaries as U
from tessera.operators.search import InvalidQuery


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_key_types(spark):
    types = spark.createDataFrame([("a", "T", "struct"), ("b", "U", "enum"), ("c", "V", "struct")], "path string, name string, kind string")
    uses = spark.createDataFrame([("b", "T"), ("b", "T"), ("c", "T"), ("a", "T"), ("a", "U"), ("b", "U")], "path string, name string")
    churn = spark.createDataFrame([("c", 9)], "path string, churn long")
    assert [tuple(r) for r in U.key_types(types, uses, churn).select("path", "name", "dependents", "churn", "label").collect()] == [("a", "T", 2, 0, "→2"), ("b", "U", 1, 0, None), ("c", "V", 0, 9, None)]


def test_health_and_telemetry_and_ledger(spark):
    f = [("a", "processed", 3, "normal", False, False, False, False), ("b", "partial", 2, "normal", False, True, True, True), ("c", "partial", None, None, False, False, False, False)]
    files = spark.createDataFrame(f, "path string, status string, n_symbols long, tier string, vendor boolean, generated boolean, test boolean, template boolean")
    assert rows(U.health(files)) == sorted([("status", "processed", 1), ("status", "partial", 2), ("tier", "normal", 2), ("partial", "generated", 1), ("partial", "unexpected", 1), ("symbols", "total", 5)], key=str)
    calls = spark.createDataFrame([(1, "x", "ok", True), (2, "y", "ok", False), (3, "y", None, True)], "id long, tool string, outcome string, success boolean")
    assert rows(U.telemetry(calls, top=1)) == sorted([("total", None, 3), ("success", None, 2), ("failure", None, 1), ("last_id", None, 3), ("tool", "y", 2), ("outcome", "ok", 2)], key=str)
    events = spark.createDataFrame([(5, True, "s"), (-9, False, "s"), (None, None, "t")], "net long, accepted boolean, session string")
    assert rows(U.ledger(events)) == [(3, -4, 1, 2)] and rows(U.ledger(events.limit(0))) == [(0, 0, 0, 0)]


def test_import_roots(spark):
    imports = spark.createDataFrame([("serde::de",), ("Serde::ser",), ("x::y",), ("os",)], "name string")
    manifests = spark.createDataFrame([("a/Cargo.toml", "dependencies.tree-sitter"), ("a/Cargo.toml", "dependencies.serde"), ("a/Cargo.toml", "dependencies.serde.version"), ("package.json", "devDependencies.lodash"), ("package.json", "scripts.test"), ("x.toml", "dependencies.no")], "path string, key string")
    assert [tuple(r) for r in U.import_roots(imports, manifests).collect()] == [("serde", 2), ("lodash", 1), ("os", 1), ("tree_sitter", 1)]


def test_windows_projects_commitments(spark):
    files = spark.createDataFrame([(f"p{i}", i) for i in range(5)], "path string, ts long")
    assert rows(U.changed_since(files, F.lit(3), F.lit(0), most=1)) == [(1, "p3", 2, 1)]
    assert U.changed_since(files, F.lit(3), F.lit(4)).count() == 5
    commits = spark.createDataFrame([(3, 9), (1, 9), (2, 8), (4, 1)], "oid long, ts long")
    assert [r.oid for r in U.newest_window(commits, 3, since=F.lit(5)).collect()] == [1, 3, 2]
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    pick = lambda **kw: {r.project for r in U.of_projects(docs, active="a", **kw).collect()}
    assert pick() == {"a"} and pick(project="b") == {"b"} and pick(projects=["b", "c"]) == {"b", "c"} and pick(projects=["*"]) == {"a", "b", "c"}
    for bad in ({"project": "a", "projects": ["b"]}, {"projects": []}):
        with pytest.raises(InvalidQuery):
            U.of_projects(docs, active="a", **bad)
    events = spark.createDataFrame([(1, "p", "read", 1), (1, "p", "edit", 3), (1, "q", "search", 4), (2, "p", "read", 5)], "call long, path string, kind string, ts long")
    assert rows(U.commitments(events)) == [(1, "p", 3), (2, "p", 5)]


def test_merges(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n long, v string")
    new = spark.createDataFrame([("b", 5, "z"), ("c", 7, "w"), ("b", 3, "q")], "k string, n long, v string")
    go = lambda **kw: rows(U.merged(table, new, ["k"], **kw))
    assert go() == [("a", 1, "x"), ("b", 5, "z"), ("c", 7, "w")]
    assert go(mode="ignore") == [("a", 1, "x"), ("b", 2, "y"), ("c", 7, "w")]
    assert go(mode="all") == [("b", 5, "z"), ("c", 7, "w")]
    assert go(mode="add", add=("n",)) == [("a", 1, "x"), ("b", 10, "z"), ("c", 7, "w")]
    for bad in ({"mode": "merge"}, {"mode": "add", "add": ("k",)}):
        with pytest.raises(ValueError):
            U.merged(table, new, ["k"], **bad)


def test_batch_edits(spark):
    files = spark.createDataFrame([("a", "0123456789"), ("b", "é日x"), ("c", "abc"), ("d", "abc"), ("e", None)], "path string, content string")
    edits = [("a", 2, 4, "--"), ("a", 0, 0, "<"), ("a", 4, 4, "|"), ("a", 10, 10, ">"), ("a", 2, 4, "--"), ("b", 1, 2, ""), ("c", 0, 2, "x"), ("c", 1, 3, "y"), ("d", 2, 9, "z"), ("e", 0, 0, "n"), ("gone", 0, 0, "n"), ("f", 0, 0, "x"), ("f", 0, 0, "y")]
    got = {r.path: (r.state, r.n_edits, r.content) for r in U.edited(files.unionByName(spark.createDataFrame([("f", "")], files.schema)), spark.createDataFrame(edits, "path string, start long, stop long, text string")).collect()}
    assert got["a"] == ("applied", 4, "<01--|456789>") and got["b"] == ("applied", 1, "éx")
    assert got["c"] == ("overlap", 2, None) and got["d"] == ("out_of_range", 1, None) and got["gone"] == ("missing", 1, None) and got["f"] == ("overlap", 2, None)

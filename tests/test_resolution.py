"""Edges of the resolution operators."""

import pytest

from tessera.operators import resolution as N


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_imports(spark):
    files = spark.createDataFrame([("pkg/a.py", "py"), ("pkg/b.py", "py"), ("other/b.py", "py"), ("lib/b.rs", "rs"), ("pkg/__init__.py", "py")], "path string, language string")
    imports = [("pkg/a.py", "py", ".b"), ("pkg/a.py", "py", "..b"), ("pkg/a.py", "py", "...b"), ("lib/b.rs", "rs", "b"), ("other/b.py", "py", "pkg"), ("pkg/b.py", "py", "b"), (None, "py", "b"), ("pkg/a.py", "py", None)]
    got = N.import_edges(spark.createDataFrame(imports, "importer string, language string, name string"), files)
    assert rows(got, "importer", "target") == [("other/b.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/b.py"), ("pkg/b.py", "other/b.py")]


def test_ranges_across_stretches(spark):
    points = spark.createDataFrame([("f", 5), ("f", 300), ("f", 700), ("g", 300), (None, 5)], "path string, pos long")
    ranges = spark.createDataFrame([("f", 1, 600), ("f", 300, 300), ("f", 9, 3)], "path string, start long, end long")
    assert rows(N.range_join(points, ranges, ["path"], "pos"), "path", "pos", "start") == [("f", 5, 1), ("f", 300, 1), ("f", 300, 300)]
    left = {(r.path, r.pos) for r in N.outside(points, ranges, ["path"], "pos").collect()}
    assert left == {("f", 700), ("g", 300), (None, 5)}


def test_selector_levels(spark):
    symbols = spark.createDataFrame([("f", "Foo", "class", 1), ("f", "Foo", "function", 2), ("f", "bar", "function", 3), ("f", "bar", "function", 4), ("f", "impl Show for Foo", "impl", 5), ("f", "@media (max-width: 9px)", "other", 6), ("f", "Solo", "function", 7)], "path string, name string, kind string, line long")
    asked = [("1", "Foo", None), ("2", "Foo", "function"), ("3", "X::bar", None), ("4", "Show for  Foo", None), ("5", "@media", None), ("6", "extension Solo: P", None), ("7", "gone", None), ("8", "bar", "class"), ("9", None, None)]
    got = N.select_symbol(symbols, spark.createDataFrame([(r, "f", w, k) for r, w, k in asked], "request string, path string, wanted string, wanted_kind string"))
    assert rows(got.where("state <> 'not_found'").fillna(0), "request", "state", "line") == [("1", "selected", 1), ("2", "selected", 2), ("3", "ambiguous", 0), ("4", "selected", 5), ("5", "selected", 6), ("6", "selected", 7)]
    assert rows(got.where("state = 'not_found'"), "request") == [("7",), ("8",), ("9",)]


def test_reexports_and_tiers(spark):
    imports = spark.createDataFrame([("x", "hub"), ("y", "hub2"), ("z", "core"), ("core", "hub")], "importer string, target string")
    hubs = spark.createDataFrame([("hub", "core"), ("hub2", "hub")], "hub string, target string")
    got = rows(N.through_reexports(imports, hubs).where("target = 'core'"), "importer", "hops")
    assert got == [("x", 1), ("y", 2), ("z", 0)]
    a, b = spark.createDataFrame([("k", 1)], "key string, v int"), spark.createDataFrame([("k", 2), ("m", 3)], "key string, v int")
    assert rows(N.first_tier([a, b], "key"), "key", "v", "tier") == [("k", 1, 0), ("m", 3, 1)]


def test_edit_impact_and_hunks(spark):
    body = "path string, name string, body string"
    got = N.edit_impact(spark.createDataFrame([("p", "same", "1"), ("p", "gone", "1"), ("p", "mod", None)], body), spark.createDataFrame([("p", "same", "1"), ("p", "new", "1"), ("p", "mod", "2")], body), spark.createDataFrame([("mod", "p"), ("mod", "q"), ("mod", "q"), ("gone", "p")], "name string, path string"))
    assert rows(got, "name", "change", "callers") == [("gone", "removed", ""), ("mod", "changed", "q"), ("new", "added", "")]
    hunks = spark.createDataFrame([(1, "p", 250, 520), (2, "p", 1, 0)], "oid long, path string, first long, last long")
    symbols = spark.createDataFrame([("p", "a", 1, 300), ("p", "b", 520, 600), ("p", "c", 521, 600)], "path string, name string, first long, last long")
    assert rows(N.hunk_symbols(hunks, symbols), "oid", "name") == [(1, "a"), (1, "b")]


def test_directions(spark):
    impls = spark.createDataFrame([("Show", "Foo"), ("Foo", "Bar")], "trait string, type string")
    assert N.implementations(impls, "Foo").count() == 2
    assert rows(N.implementations(impls, "Foo", "type"), "trait") == [("Show",)]
    with pytest.raises(ValueError):
        N.implementations(impls, "Foo", "up")
    files = spark.createDataFrame([("out/a",), ("src/b",), ("lib/out/c",)], "path string")
    assert rows(N.demoted(files, spark.createDataFrame([("lib/out/d",)], "path string"), ["out"]), "path") == [("out/a",)]
    assert N.owned(files, []).where("rules <> 0").count() == 0


def test_header_language(spark):
    cases = spark.createDataFrame([(False, 0, 0, False), (True, 0, 5, False), (False, 3, 2, False), (True, 3, 0, True), (False, 2, 2, False)], "m boolean, c int, x int, o boolean")
    from pyspark.sql import functions as F

    got = [r[0] for r in cases.select(N.header_language(F.col("m"), F.col("c"), F.col("x"), F.col("o"))).collect()]
    assert got == ["c", "cpp", "cpp", "c", "c"]

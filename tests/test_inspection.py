"""Edges of inspection, edit previews, configuration facts, promotions and stream helpers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction as E, inspection as I, views as V
from tessera.sources import snapshots
from tessera.streaming import access


def test_enclosing_and_siblings(spark):
    symbols = spark.createDataFrame([("p", "A", 0, 1, 900), ("p", "m", 1, 10, 20), ("p", "n", 1, 30, 40), ("p", "B", 0, 901, 950)], "path string, name string, depth int, start long, end long")
    hits = spark.createDataFrame([("p", 10, "x"), ("p", 25, "import y"), ("p", 999, "z"), ("q", 1, "w")], "path string, line_no long, line string")
    got = {(r.path, r.line_no): r.symbol for r in I.enclosing(hits, symbols).collect()}
    assert got == {("p", 10): "m", ("p", 25): "A", ("p", 999): None, ("q", 1): None}
    seen = {(r.path, r.line_no): (r.parents, r.siblings, r.overflow) for r in I.inspect(hits, symbols, siblings=1).collect()}
    assert seen == {("p", 10): ("A > m", "n", 0), ("p", 25): ("A", "B", 0), ("p", 999): (None, None, None), ("q", 1): (None, None, None)}
    assert [r.symbol for r in I.grouped_hits(hits, symbols, "names").orderBy("symbol").collect()] == ["A", "m"]
    assert I.grouped_hits(hits, symbols, "usage", noise=F.col("line").startswith("import")).count() == 3
    with pytest.raises(ValueError):
        I.grouped_hits(hits, symbols, "line")


def test_rename(spark):
    lines = spark.createDataFrame([("p", 1, 'foo(foo, "foo") // foo'), ("p", 2, "foobar"), ("p", 3, "")], "path string, line_no int, line string")
    row = I.rename_preview(lines, "foo", "b$r").first()
    assert (row.sites, row.certain, row.after) == (4, 2, 'b$r(b$r, "b$r") // b$r')
    for bad in (("", "a"), ("a", ""), ("a", "a")):
        with pytest.raises(ValueError):
            I.rename_preview(lines, *bad)


def test_edit_plan(spark):
    edits = spark.createDataFrame([("p", 0, 3, "a"), ("p", 3, 5, "b"), ("p", 4, 6, "c"), ("p", 9, 8, "d"), ("p", 0, 3, "a"), ("p", 20, 20, "e"), ("q", -1, 2, "f")], "path string, start long, end long, text string")
    got = {r.text: r.state for r in I.edit_plan(edits).collect()}
    assert got == {"a": "applicable", "b": "overlap", "c": "overlap", "d": "invalid", "e": "applicable", "f": "invalid"}


def test_manifests_and_distance(spark):
    files = spark.createDataFrame([("pkg/lib/a.js",), ("a.js",)], "path string")
    manifests = spark.createDataFrame([("pkg/package.json", '{"main": "./lib/a.js", "types": "x.d.ts"}'), ("package.json", "{broken"), ("z.json", None)], "path string, content string")
    assert [tuple(r) for r in I.manifest_paths(manifests, files).collect()] == [("pkg/package.json", "pkg/lib/a.js")]
    parents = spark.createDataFrame([("d", "c"), ("c", "b"), ("c", "x"), ("b", "a"), ("a", None)], "child string, parent string")
    # what d reaches and the start doesn't: x came in by a merge
    assert [I.commit_distance(parents, s, "d") for s in ("d", "b", "a", "nope")] == [0, 3, 4, None]
    assert I.ahead_behind(parents, "b", "x") is None and I.ahead_behind(parents, "x", "d") == (0, 4)


@pytest.mark.parametrize("stride", [1, 4])
def test_diverged_histories(spark, stride):
    r = random.Random(5)
    links = {0: []}
    for i in range(1, 60):
        links[i] = r.sample(range(max(0, i - 6), i), min(i, r.choice([1, 1, 2])))
    links |= {100: [], 101: [100]}
    rows = [(str(c), str(p)) for c, ps in links.items() for p in ps] + [("0", None)]
    parents = spark.createDataFrame(rows, "child string, parent string")

    def reached(c):
        todo, seen = [c], {c}
        while todo:
            for p in links[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    for a, b in [(59, 55), (40, 58), (7, 7), (101, 20)]:
        x, y = reached(a), reached(b)
        want = (len(x - y), len(y - x)) if x & y else None
        assert I.ahead_behind(parents, str(a), str(b), stride=stride) == want


def test_nearest_matches(spark):
    def plain(old, new):
        left, pairs = sorted(old), []
        for n in sorted(new):
            best = min(left, key=lambda o: abs(o - n), default=None)
            if best is not None:
                left.remove(best)
            pairs.append((best, n))
        return pairs + [(o, None) for o in left]

    r = random.Random(9)
    cases = {"a": ([10], [5, 11]), "b": ([], [1]), "c": ([4, 4], []), "d": ([10, 20, 30], [14, 15, 16])}
    cases |= {f"r{i}": ([r.randrange(40) for _ in range(r.randrange(7))], [r.randrange(40) for _ in range(r.randrange(7))]) for i in range(40)}
    old = spark.createDataFrame([(k, x) for k, (o, _) in cases.items() for x in o], "name string, line long")
    new = spark.createDataFrame([(k, x) for k, (_, n) in cases.items() for x in n], "name string, line long")
    got = {}
    for row in V.nearest_matches(old, new, ["name"]).collect():
        got.setdefault(row.name, []).append((row.old_line, row.new_line))
    for k, (o, n) in cases.items():
        assert sorted(got.get(k, []), key=str) == sorted(plain(o, n), key=str)


def test_configuration(spark):
    assert E.flatten('[a]\nb = [1, 2]\nc = 2020-01-01\n', language="toml") == [("a.b[0]", "1"), ("a.b[1]", "2"), ("a.c", '"2020-01-01"')]
    assert E.flatten("= broken", language="toml") == [] == E.flatten("{", language="json") == E.flatten(None)
    keys = [("w", "on.push.branches[0]", "main"), ("w", "jobs.build.runs-on", "linux"), ("w", "jobs.test.needs[0]", "build"), ("w", "jobs.test.strategy.matrix.os[0]", "linux"), ("w", "jobs.test.steps[0].run", "make"), ("c", "jobs.x.y", "1"), ("c", "name", None)]
    got = sorted(tuple(r) for r in E.workflow_facts(spark.createDataFrame(keys, "id string, key string, value string")).collect())
    assert got == [("w", "job", "build", "build"), ("w", "matrix", "test", "os=linux"), ("w", "needs", "test", "build"), ("w", "step", "test", "run=make"), ("w", "trigger", "", "push")]
    sources = spark.createDataFrame([("a.py", "import numpy as np\nfrom m import f as g, h\nimport os as os"), ("b.py", "def"), ("c.py", None)], "path string, content string")
    assert sorted(tuple(r) for r in E.python_aliases(sources).collect()) == [("a.py", "g", "f"), ("a.py", "np", "numpy")]


def test_yaml_workflow(spark):
    pytest.importorskip("yaml")
    assert E.flatten("on: push\njobs:\n  a: {needs: b}\n", language="yaml") == [("True", "push"), ("jobs.a.needs", "b")]


def test_promotion(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.current(spark, root) is None
    path, mark = snapshots.write(spark.range(3).toDF("k"), root)
    for flags in ({"complete": False, "stable": True}, {"complete": True, "stable": False}):
        with pytest.raises(snapshots.Refused):
            snapshots.promote(spark, root, path, mark, **flags)
    with pytest.raises(snapshots.Refused):
        snapshots.promote(spark, root, path, "0:0:0", complete=True, stable=True)
    snapshots.promote(spark, root, path, mark, complete=True, stable=True)
    assert snapshots.current(spark, root) == path


def test_stream_helpers(spark):
    stat = "path string, size long, modified long"
    known = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], stat)
    disk = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], stat)
    assert sorted(map(tuple, access.reconcile(known, disk).collect())) == [("b", "modify"), ("c", "delete"), ("d", "add")]
    asked = spark.createDataFrame([("a",), ("c",), ("c",)], "path string")
    assert [tuple(r) for r in access.stale(asked, known, disk).collect()] == [("c", "delete")]
    batch = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None)], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    assert [r.path for r in access.changed_content(batch, old).collect()] == ["b"]
    day = dt.datetime(2024, 1, 1)
    reads = spark.createDataFrame([("s", "a", 5, day), ("s", "a", 5, day), ("s", "b", 1, day)], "session string, path string, tokens long, ts timestamp")
    seen = access.session_seen(access.session_seen(spark.createDataFrame([], "session string, path string, reads long, tokens long, last_ts timestamp"), reads), reads.limit(1))
    assert [tuple(r)[:5] for r in access.session_summary(seen).collect()] == [("s", 4, 2, 2, 16)]
    events = spark.createDataFrame([(i, day) for i in range(5)], "id int, ts timestamp")
    taken, counts = access.bounded_queue(events, 3)
    assert ([r.id for r in taken.collect()], tuple(counts.first())) == ([0, 1, 2], (3, 2))
    entries = spark.createDataFrame([("new", day), ("old", day - dt.timedelta(minutes=16)), ("never", None)], "path string, verified_ts timestamp")
    assert [r.path for r in access.unverified(entries, "2024-01-01 00:00:00").collect()] == ["never", "old"]

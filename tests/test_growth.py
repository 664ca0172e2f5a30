"""Work that grows with the input, not with the square of a group, and state that is spread over tasks."""

import random
import time

import pyarrow as pa
import pytest

import tessera.plans  # noqa: F401
from tessera.operators import history as H, impact as M, inspection as I, relations as R, resolution as N, sourcecode as S, symbolviews as W, views as V
from tessera.plans.registry import QUERIES


@pytest.fixture
def planned(spark):
    """Plans as they are made, so that their nodes can be looked at."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def nodes(df):
    """All nodes of a plan that has run."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def join_rows(df):
    """The most rows that a join of a plan made."""
    return max((n.metrics().apply("numOutputRows").value() for n in nodes(df) if "Join" in n.nodeName() and n.metrics().contains("numOutputRows")), default=0)


def test_nearest_matches_of_a_large_group(spark):
    n = 30_000
    old = spark.range(n).selectExpr("'f' AS name", "id * 2 AS line")
    new = spark.range(n).selectExpr("'f' AS name", "id * 2 + 1 AS line")
    begin = time.monotonic()
    got = {(x.old_line, x.new_line) for x in V.nearest_matches(old, new, ["name"]).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(n)}
    assert time.monotonic() - begin < 60


def test_nearest_matches_by_choosing_one_after_another(spark):
    def plainly(old, new):
        left, out = sorted(old), []
        for y in sorted(new):
            x = min(((abs(x - y), x) for x in left), default=(0, None))[1]
            if x is not None:
                left.remove(x)
            out.append((x, y))
        return out + [(x, None) for x in left]

    rng = random.Random(1)
    groups = {(f"n{g % 50}", g // 50 or None): ([rng.randrange(15) for _ in range(rng.randrange(8))], [rng.randrange(15) for _ in range(rng.randrange(8))]) for g in range(300)}
    frame = lambda side: spark.createDataFrame([(*k, line) for k, v in groups.items() for line in v[side]], "name string, kind int, line int")
    got = sorted(V.nearest_matches(frame(0), frame(1), ["name", "kind"]).collect(), key=str)
    want = [(*k, *p) for k, v in groups.items() for p in (plainly(*v) if k[1] is not None else [(x, None) for x in v[0]] + [(None, y) for y in v[1]])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_requests_meet_a_row_of_each_kind(planned):
    symbols = planned.range(500).selectExpr("'f' AS path", "'run' AS name", "IF(id = 7, 'class', 'function') AS kind", "id AS line")
    asked = planned.range(400).selectExpr("id AS request", "'f' AS path", "IF(id % 2 = 0, 'run', 'a::run') AS wanted", "CAST(IF(id % 4 = 3, 'function', NULL) AS STRING) AS wanted_kind")
    got = N.select_symbol(symbols, asked)
    rows = {x.request: (x.state, x.candidates, x.line) for x in got.collect()}
    assert all(v == (("ambiguous", 499, None) if k % 4 == 3 else ("selected", 500, 7)) for k, v in rows.items()) and len(rows) == 400
    assert join_rows(got) <= 400 * 2 * 3


def test_calls_meet_a_row_of_each_word(planned):
    definitions = planned.range(500).selectExpr("id AS node", "'run' AS name", "IF(id = 3, 'src/b.rs', 'src/a.rs') AS path", "CAST(NULL AS STRING) AS owner")
    calls = planned.range(400).selectExpr("id AS call", "'run' AS name", "IF(id % 2 = 0, 'a::run', 'b::run') AS qualified")
    got = R.resolve_qualified(calls, definitions)
    assert {(x.call, x.node) for x in got.collect()} == {(i, 3) for i in range(1, 400, 2)}
    assert join_rows(got) <= 400


def test_pairs_sort_a_log_once(planned):
    log = planned.range(3000).selectExpr("id % 300 AS oid", "concat('p', id % 7 * (id % 300 % 4) + id DIV 300) AS path", "timestamp'2000-01-01' AS ts")
    many = planned.range(60).selectExpr("-1L AS oid", "concat('q', id) AS path", "timestamp'2000-01-01' AS ts")
    every = log.unionByName(many)
    found = H.ledger(every, most_files=50)
    plan = nodes(found)
    rows = [(x.oid, x.a, x.b) for x in found.collect()]
    assert not any("Join" in n.nodeName() for n in plan)
    assert sum(n.nodeName() == "Sort" for n in plan) <= 2
    by = {}
    for x in every.collect():
        by.setdefault(x.oid, set()).add(x.path)
    assert sorted(rows) == sorted((o, a, b) for o, p in by.items() if len(p) <= 50 for a in p for b in p if a < b)


def test_counted_commits_dont_share_a_stage_with_joins(planned):
    log = planned.range(100).selectExpr("id % 9 AS oid", "concat('p', id % 5) AS path", "id % 3 AS author", "timestamp'2000-01-01' AS ts").join(planned.range(9).selectExpr("id AS oid"), "oid")
    for f in (H.churn(log, "2000-01-02 00:00:00"), H.ownership(log)):
        text = f._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in text
    edges = planned.range(50).selectExpr("id % 7 AS importer", "id % 5 AS target")
    found = N.through_reexports(edges, edges.selectExpr("importer AS hub", "target"))
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_facts_leave_in_stretches(spark, monkeypatch):
    """A batch of many files is passed on in stretches of rows, and only records asked for are made."""
    n = 2000
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.py" for i in range(n)], "language": ["python"] * n, "content": [f"def f():\n    g({i})\nx = f()\n" for i in range(n)]})
    passed = [b.num_rows for b in S._batches(iter([batch]), S.RECORDS)]
    assert sum(passed) == sum(len(S.read("python", c.as_py())) for c in batch.column("content")) > S.STRETCH == max(passed)
    files = spark.createDataFrame(batch.slice(0, 50).to_pylist())
    every = {r: S.extract(files).where(f"record = '{r}'").orderBy("path", "start", "name").collect() for r in S.RECORDS}
    for r in S.RECORDS:
        assert S.extract(files, records=[r]).orderBy("path", "start", "name").collect() == every[r]
    assert every["symbol"] and every["reference"] and every["status"]


def test_callers_parse_each_file_once(planned, tmp_path):
    planned.sql("SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id AS l_suppkey FROM range(5)").write.parquet(f"{tmp_path}/lineitem.parquet")
    planned.sql("SELECT id AS o_orderkey, IF(id = 1, 'P', 'O') AS o_orderstatus FROM range(5)").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["source_callers"](planned, str(tmp_path))
    assert sum("MapInArrow" in n.nodeName() or "MapInPandas" in n.nodeName() for n in nodes(got)) == 1
    assert {tuple(x) for x in got.collect()} >= {(f"orders/{k}.{e}", "line_1", f"part_{k}", 1) for k, e in enumerate(["rs", "py", "ts", "java", "go"])}


def test_edit_plan_of_a_large_file(planned):
    n = 3000
    edits = planned.range(n).selectExpr("'f' AS path", "id * 10 AS start", "id * 10 + IF(id % 3 = 0, 11, 5) AS end", "'t' AS text")
    unknown = planned.sql("SELECT 'g' AS path, NULL AS start, 5 AS end, 't' AS text UNION ALL SELECT 'g', NULL, 7, 't' UNION ALL SELECT 'g', 3, NULL, 't'")
    got = I.edit_plan(edits.unionByName(unknown))
    assert "UnboundedFollowing" not in got._jdf.queryExecution().optimizedPlan().toString().replace(" ", "").replace("unboundedfollowing", "UnboundedFollowing")
    state = {(x.path, x.start, x.end): x.state for x in got.collect()}
    # each third edit reaches into the next
    assert all(state["f", i * 10, i * 10 + (5, 11)[i % 3 == 0]] == ("applicable" if i % 3 == 2 else "overlap") for i in range(n - 1))
    assert state["g", None, 5] == state["g", None, 7] == "overlap" and state["g", 3, None] == "overlap"


def test_chosen_columns_of_facts(spark):
    files = spark.createDataFrame([("a.py", "python", "class A:\n    def f(self):\n        return g(1)\n")], "path string, language string, content string")
    every, some = S.extract(files), S.extract(files, records=["symbol", "reference"], columns=["name", "kind"])
    assert some.columns == ["path", "record", "name", "kind"] and {"around", "around_kind"} <= set(every.columns)
    assert [(x.name, x.first_line, x.digest) for x in S.symbols(some).orderBy("name").collect()] == [("A", None, None), ("f", None, None)]
    assert [(x.name, x.around, x.around_kind) for x in S.references(every).collect()] == [("g", "f", "method")]
    assert [(x.name, x.around) for x in S.symbols(every).orderBy("name").collect()] == [("A", None), ("f", "A")]


def test_plain_files_have_the_same_tokens():
    rng = random.Random(2)
    for _ in range(300):
        content = "".join(rng.choice(["def f(x):", "\n", "  ", "a::b", "->", "1.5e3", "é", "x", "(", ")", "{", "٣", "\r\n", "$y", "_z", "=>", ";"]) for _ in range(rng.randrange(40)))
        source = S.Source("typescript", content)
        assert [*zip(source.kinds, source.texts, source.starts, source.lines, strict=True)] == source._lex()


def test_calls_are_placed_without_a_join(planned):
    files = planned.createDataFrame([(f"{i}.py", "python", f"def f{i}():\n    return f{i + 1}()\n") for i in range(20)], "path string, language string, content string")
    facts = S.extract(files).cache()
    got = M.call_edges(facts)
    assert {tuple(x) for x in got.collect()} == {(f"{i}.py::f{i}", f"{i + 1}.py::f{i + 1}") for i in range(19)}
    assert sum("Join" in n.nodeName() for n in nodes(got)) == 1  # calls with definitions
    asked = planned.createDataFrame([("q", "3.py", "f3", None, None)], "request string, path string, name string, kind string, line int")
    callers = W.entries(asked, facts, files, sections=["callers"])
    assert [(x.path, x.detail) for x in callers.collect()] == [("2.py", "in function f2")]
    assert sum("Join" in n.nodeName() for n in nodes(callers)) == 2  # requests with symbols, names with calls


def test_unchanged_files_arent_read_without_hops(planned, monkeypatch):
    frame = lambda n: planned.createDataFrame([(f"{i}.py", "python", f"def f{i}():\n    return {n if i == 3 else 0}\n") for i in range(20)], "path string, language string, content string")
    read, extract = [], S.extract
    monkeypatch.setattr(S, "extract", lambda files, *a, **k: read.append(files.count()) or extract(files, *a, **k))
    found = M.impact(frame(1), frame(2), M.options(["main"], depth=0))
    assert [(x.path, x.name, x.change) for x in found.symbols.collect()] == [("3.py", "f3", "changed")] and found.blast.count() == 0
    assert read == [1, 1]


def test_versions_meet_once(planned):
    """Changed files come with their texts from one join, so neither version is gone through again for them."""
    frame = lambda rows: planned.createDataFrame(rows, "path string, language string, content string")
    old = frame([("a.py", "python", "def a():\n    return 1\n"), ("b.py", "python", "def b():\n    return 1\n"), ("c.py", "python", "def c():\n    return a()\n"), ("d.py", "python", None), (None, "python", "def n(): pass\n")])
    new = frame([("a.py", "python", "def a():\n    return 2\n"), ("e.py", "python", "def e():\n    return 1\n"), ("c.py", "python", "def c():\n    return a()\n"), ("d.py", "python", None), ("f.py", "python", None)])
    contents = M.changed_contents(old, new)
    assert {(x.path, x.change) for x in contents.collect()} == {("a.py", "modified"), ("b.py", "removed"), ("e.py", "added"), ("f.py", "added"), (None, "removed")}
    assert sum("Join" in n.nodeName() for n in nodes(contents)) == 1
    found = M.impact(old, new, M.options(["main"]))
    assert {(x.path, x.name, x.change) for x in found.symbols.collect()} == {("a.py", "a", "changed"), ("b.py", "b", "removed"), ("e.py", "e", "added")}
    assert {tuple(x) for x in found.blast.collect()} == {("c.py::c", 1, "high")} and found.files.count() == 5


def test_unchanged_files_of_both_versions_are_written_once(planned, tmp_path):
    from tessera.plans import source_queries as Q

    planned.sql("SELECT id AS p_partkey, 40 + id AS p_size FROM range(9)").write.parquet(f"{tmp_path}/part.parquet")
    planned.sql("SELECT id DIV 2 AS l_orderkey, IF(id = 3, NULL, 8 - id) AS l_partkey FROM range(9)").write.parquet(f"{tmp_path}/lineitem.parquet")
    planned.sql("SELECT id AS o_orderkey, id % 2 AS o_custkey FROM range(5)").write.parquet(f"{tmp_path}/orders.parquet")
    old, new = Q.versions(planned, str(tmp_path))
    for version in (old, new):
        assert "lineitem" not in version._jdf.queryExecution().optimizedPlan().toString().lower() and len(version.inputFiles()) > 0
    texts = {x.path: x.content for x in new.collect()}
    assert texts["orders/0.py"] == "def order_0(n):\n    return part_7(n) + part_8(n)\n" and texts["orders/1.py"] == "def order_1(n):\n    return part_6(n)\n"
    assert texts["customers/1.go"] == "package main\n\nfunc customer_1(n int) int {\n\treturn order_1(n) + order_3(n)\n}\n"
    assert texts["nations/3.rs"] == "fn main() {\n    let n = 1;\n    part_3(n);\n}\n" and texts["parts/6.ts"] == "// moved\n\nexport function part_6(n: number): number {\n  return n + 47;\n}\n"


def test_callers_come_with_their_calls(planned):
    """Calls aren't brought together with the symbols of their files again, and symbols aren't extracted."""
    got = QUERIES["source_callers"](planned, "/root/testdata/sf0.001")
    names = [n.nodeName() for n in nodes(got)]
    assert not [n for n in names if n.startswith("Window")] and "MapInArrow" in names
    assert {r.caller[:5] for r in got.where("called LIKE 'part%'").collect()} == {"line_"}

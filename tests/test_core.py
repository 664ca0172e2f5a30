"""Small cases of operators whose edges the registered tables don't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera import graph
from tessera.operators import admission as A, history as H, relations as R, search as S
from tessera.sources import snapshots
from tessera.streaming import access


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (3, 1)], "u long, v long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_queries_are_validated():
    for bad in (lambda: S.literal(""), lambda: S.regex("("), lambda: S.regex(""), lambda: S.any_of([]), lambda: S.whole_word("")):
        with pytest.raises(S.InvalidQuery):
            bad()


def test_text_search_caps(spark):
    lines = spark.createDataFrame([(p, i, "hit") for p, n in (("a", 4), ("b", 9), ("c", 1)) for i in range(1, n + 1)], "path string, line_no long, line string")
    got = S.text_search(lines, S.literal("HIT"), per_file=3, total=5).collect()
    assert sorted((r.path, r.line_no) for r in got) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]


def test_context_merges(spark):
    lines = spark.createDataFrame([("p", i, "x" if i in (2, 5, 9) else "-") for i in range(1, 11)], "path string, line_no long, line string")
    got = S.context_windows(lines, S.literal("x"), 1).orderBy("block").collect()
    assert [(r.first_line, r.last_line) for r in got] == [(1, 6), (8, 10)]


def test_short_query_scans(spark):
    units = spark.createDataFrame([(1, "ab"), (2, "xyz")], "id long, text string")
    assert [r.id for r in S.trigram_search(units.select("id", F.lit("").alias("gram")), units, "B").collect()] == [1]


def log_rows(spark, rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(o, p, day + dt.timedelta(days=d), a) for o, p, d, a in rows], "oid long, path string, ts timestamp, author string")


def test_large_commits_stay_in_denominators(spark):
    rows = [(1, p, 0, "x") for p in ("a", "b")] + [(2, p, 1, "x") for p in ("a", "b")] + [(3, p, 2, "y") for p in ("a", "b", "c", "d")]
    got = H.co_change(log_rows(spark, rows), shared=2, least=0.0, most_files=3).collect()
    assert [(r.a, r.b, r.shared, r.jaccard) for r in got] == [("a", "b", 2, round(2 / 4, 6))]


def test_churn_of_one_path_and_future(spark):
    got = H.churn_rank(H.churn(log_rows(spark, [(1, "a", 5, "x")]), "2024-01-01 00:00:00")).first()
    assert (got.commits, got.churn, got.place) == (1, 1.0, 1.0)


def test_advance_equals_a_new_build(spark):
    rows = [(o, p, d, "x") for o, d, ps in ((1, 0, "ab"), (2, 3, "abc"), (3, 8, "bc"), (4, 9, "ad")) for p in ps]
    ledger = H.ledger(log_rows(spark, rows))
    cut = dt.datetime(2024, 1, 3)
    mid, end = "2024-01-08 00:00:00", "2024-01-11 00:00:00"
    old = ledger.where(F.col("ts") < dt.datetime(2024, 1, 8))
    moved = H.advance(H.weighted(old, mid), old, ledger.where(F.col("ts") >= dt.datetime(2024, 1, 8)), old.where(F.col("ts") < cut), before=mid, now=end)
    anew = H.weighted(ledger.where(F.col("ts") >= cut), end)
    flat = lambda df: sorted((r.a, r.b, r.shared, round(r.weight, 9), r.last_ts) for r in df.collect())
    assert flat(moved) == flat(anew) and len(flat(moved)) == 4


@pytest.mark.parametrize("distance,hits", [(0, 5), (49, 5), (50, 2), (500, 2), (501, 0), (None, 0)])
def test_frecency_reset(spark, distance, hits):
    stats = spark.createDataFrame([("p", 5)], "path string, hits long")
    assert H.frecency_reset(stats, F.lit(distance).cast("int")).first().hits_after == hits


def test_reach(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "z")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("c",)], "node string")
    assert {(r.node, r.hop) for r in R.reach(edges, seeds, 5).collect()} == {("b", 1), ("d", 1)}
    assert R.reach(edges, spark.createDataFrame([("q",)], "node string"), 5).count() == 0


def test_ambiguous_names_resolve_nothing(spark):
    calls = spark.createDataFrame([(1, "f"), (2, "g"), (3, "h")], "call long, name string")
    defs = spark.createDataFrame([("f", "m1"), ("g", "m1"), ("g", "m2")], "name string, node string")
    assert [(r.call, r.node) for r in R.resolve_unique(calls, defs).collect()] == [(1, "m1")]


@pytest.mark.parametrize("size,data,want", [(100 * A.MIB + 1, False, "hard_skip"), (100 * A.MIB, False, "too_large"), (A.MIB, True, "normal"), (A.MIB + 1, True, "too_large"), (4 * A.MIB, False, "normal"), (4 * A.MIB + 1, False, "too_large")])
def test_admission_limits(spark, size, data, want):
    no = F.lit(False)
    assert spark.range(1).select(A.tier(F.lit(size), F.lit(data), no, no, no).alias("t")).first().t == want


@pytest.mark.parametrize("n,state", [(0, "deferred"), (23, "accumulating"), (24, "tuned")])
def test_calibration_states(spark, n, state):
    rows = [(1.0, 9.0, i % 2 == 0) for i in range(n)] + [(0.0, 1.0, True)]
    got = A.calibration(spark.createDataFrame(rows, "predicted double, actual double, held boolean"))
    got = got.first()
    assert got.state == state if n else got.n in (None, 0)
    assert not n or got.factor == 4.0


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    path, mark = snapshots.write(df, str(tmp_path))
    assert snapshots.write(df.repartition(3), str(tmp_path), known=mark) == ("", mark)
    assert snapshots.load(spark, path, df.schema).count() == 2
    with pytest.raises(snapshots.Refused):
        snapshots.load(spark, path, df.withColumn("k", F.col("k").cast("int")).schema)
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.txt").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "tree" / "b.txt").write_bytes(b"\xff")
    tree = snapshots.decoded(snapshots.scan_tree(spark, str(tmp_path / "tree")))
    assert sorted(r.text or "" for r in tree.collect()) == ["", "hi"]
    with pytest.raises(snapshots.Refused):
        snapshots.scan_tree(spark, str(tmp_path / "tree"), most_files=1)


def test_access_stream_equals_a_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(p, day + dt.timedelta(hours=i)) for i, p in enumerate("abacab")]
    df = spark.createDataFrame(rows, "path string, ts timestamp").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = access.state_sink(stream, str(tmp_path / "state"), str(tmp_path / "check")).start()
    query.awaitTermination(120)
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    empty = spark.createDataFrame([], "path string, hits long, last_ts timestamp")
    want = access.merge_access(empty, df)
    assert sorted(map(tuple, spark.read.parquet(str(last)).collect())) == sorted(map(tuple, want.collect()))


def test_debounce_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", "add", day + dt.timedelta(seconds=s)) for s in (0, 2, 20)] + [("z", "end", day + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "path string, op string, ts timestamp").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = access.debounced(stream, late="1 minute").writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.path, r.events) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2)]


def test_fence(spark):
    live = spark.createDataFrame([("a", 3)], "path string, generation long")
    late = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "path string, generation long")
    assert sorted(map(tuple, access.fenced(late, live).collect())) == [("a", 3), ("b", 1)]

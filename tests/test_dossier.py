"""Policy entries, timelines, findings, dossiers and plans on small tables."""

from tessera.operators import dossier as D


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_entries(spark):
    units = spark.createDataFrame([(p, f"h{p}") for p in "abcdefg"], "path string, hash string")
    told = [(1, "a", "ha", "active", None, None), (2, "b", "old", "active", None, None), (3, "c", "hc", "superseded", "d", "hd"), (4, "d", "hd", "superseded", None, None), (5, "e", "he", "superseded", "f", "hf"), (6, "f", "hf", "superseded", "e", "he"), (7, "g", "hg", "superseded", "a", "old"), (8, "z", "hz", "active", None, None)]
    policy = spark.createDataFrame(told, "entry long, target string, target_hash string, lifecycle string, successor string, successor_hash string")
    assert {r.entry: r.reason for r in D.entries(units, policy).collect()} == {1: None, 2: "target_changed", 3: None, 4: "no_successor", 5: "cyclic", 6: "cyclic", 7: "successor_changed", 8: "target_changed"}


def test_timeline_and_as_of(spark):
    contents = spark.createDataFrame([("p", 1, "A"), ("p", 5, "B"), ("p", 6, "B"), ("p", 9, "A"), ("q", 4, "A")], "path string, ts long, hash string")
    policies = spark.createDataFrame([("p", 3, "A", "active"), ("p", 5, "B", "draft"), ("p", 8, "A", "active"), ("q", 2, "A", "active")], "path string, ts long, target_hash string, lifecycle string")
    got = D.timeline(contents, policies)
    assert rows(got) == sorted([("p", 1, 3, "A", "unknown"), ("p", 3, 5, "A", "active"), ("p", 5, 8, "B", "draft"), ("p", 8, 9, "B", "unknown"), ("p", 9, None, "A", "active"), ("q", 2, 4, None, "unknown"), ("q", 4, None, "A", "active")], key=str)
    asked = spark.createDataFrame([("p", 0), ("p", 5), ("p", 100), ("r", 1)], "path string, at long")
    assert rows(D.as_of(got, asked)) == sorted([("p", 0, None, None), ("p", 5, "B", "draft"), ("p", 100, "A", "active"), ("r", 1, None, None)], key=str)


def test_findings_and_copies(spark):
    found = spark.createDataFrame([("f", f"p{i:02}") for i in range(20)] * 2 + [("g", "x")], "finding string, path string")
    assert rows(D.finding_index(found, samples=3)) == [("f", 20, "p00,p01,p02"), ("g", 1, "x")]
    units = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2"), ("d", None)], "path string, hash string")
    assert rows(D.copies(units)) == [("a", "1", 2, None), ("b", "1", 2, "a"), ("c", "2", 1, None), ("d", None, 1, None)]


def test_dossiers_and_plan(spark):
    told = [
        ("a", "superseded", "guide", "current", "consistent", "x", None, 0, False), ("b", "superseded", "guide", "current", "consistent", None, None, 0, False), ("c", "active", "guide", "current", "consistent", None, "a", 2, True),
        ("d", "active", "guide", "intent", "implementation_gap", None, None, 0, False), ("e", "active", "historical_record", "history_only", "consistent", None, None, 0, False), ("f", "active", "guide", "intent", "consistent", None, None, 0, False), ("g", "active", "guide", "intent", "consistent", None, "a", 0, False),
    ]
    records = D.dossiers(spark.createDataFrame(told, "path string, lifecycle string, domain string, voice string, display string, successor string, retained string, inbound long, protected boolean"))
    got = {r.path: (r.action, r.confidence, r.preconditions) for r in records.collect()}
    assert got == {"a": ("mark_superseded", "deterministic", ""), "b": ("keep", "deterministic", ""), "c": ("remove_duplicate", "strong", "move_links,protected_role"), "d": ("update", "strong", "user_judgment"), "e": ("archive", "strong", "user_judgment"), "f": ("needs_review", "signal", ""), "g": ("remove_duplicate", "strong", "")}
    assert [(r.nth, r.path, r.steps) for r in D.plan(records, 4).orderBy("nth").collect()] == [(1, "a", 6), (2, "g", 6), (3, "f", 6), (4, "c", 6)]
    totals = {(r.fact, r.value): r.n for r in D.totals(records).collect()}
    assert totals["flag", "all"] == 7 and totals["flag", "copy"] == 2 and totals["action", "keep"] == 1 and totals["voice", "intent"] == 3

"""Edges of the knowledge and evidence operators, some against plain Python."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence as V, knowledge as K


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(build(F.col("v")).alias("r"), "i").orderBy("i").collect()]


def test_sensitive_paths(spark):
    cases = {".env": "environment", "a/.env.local": "environment", "a/.env.example": None, "prod.env": "environment", "x/id_rsa": "private", "certs/private-a.pem": "private", "certs/public.pem": None, "h\\.aws\\credentials": "cloud", "secret-notes.md": None, "s.tfstate.backup": "infrastructure", ".NETRC": "network", None: None}
    got = column(spark, list(cases), V.sensitive_path)
    assert [g and g.split(".")[1].split("-")[0] for g in got] == list(cases.values())
    assert column(spark, ["a/.Notes/x", "b/c", ".notes", "x\\.notes\\y", None], lambda c: V.personal_path(c, [".notes"])) == [True, False, False, True, None]


def test_line_kinds(spark):
    cases = {"  import x": "import", "from a import b": "import", "from afar": "code", "let q = require('x')": "import", "#include <x>": "import", "/// says": "documentation", "# TODO later": "marked", "# said": "comment", "#": "comment", "#[derive]": "code", "* item": "comment", "x = 1": "code", "": "code", None: "code"}
    assert column(spark, list(cases), V.line_kind) == list(cases.values())
    assert column(spark, ["i", "aaaa", "Get", "resolve"], lambda c: V.low_signal(c, ["get"])) == [True, True, True, False]


def test_pointer_and_nul(spark):
    head = "version https://git-lfs.github.com/spec/v1\noid sha256:"
    got = column(spark, [f"{head}{'a' * 64}\nsize 12\n", f"{head}{'a' * 63}\nsize 12\n", f"{head}{'a' * 64}\r\nsize 7", "", None, f"{head}{'a' * 64}\nsize 1\nmore"], V.lfs_pointer)
    assert [g and g.size for g in got] == [12, None, 7, None, None, None]
    got = column(spark, ["", "a\x00b\x00", "\x00" * 7, "abc"], V.nul_scan)
    assert [(g["count"], g.offsets) for g in got] == [(0, []), (2, [1, 3]), (7, [0, 1, 2, 3, 4]), (0, [])]


def test_links_do_not_overlap(spark):
    text = "see [a `x/y.py` b](docs/a.md) and `src/b.rs` and src/c.py, docs/a.md. `src/b.rs`"
    units = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = sorted(tuple(r) for r in K.link_candidates(units).collect())
    assert got == [(1, "code", "src/b.rs", 2), (1, "link", "docs/a.md", 1), (1, "path", "docs/a.md", 1), (1, "path", "src/c.py", 1)]


def test_excerpts(spark):
    def plain(line, phrase, most=20, snap=5):
        if line is None or len(line) <= most:
            return line
        at = max(line.lower().find(phrase), 0)
        end = min(max(at - (most - len(phrase)) // 2, 0) + most, len(line))
        start = max(end - most, 0)
        if start > 0:
            gap = next((i for i in range(start, min(start + snap, len(line))) if line[i] in " \t"), None)
            if gap is not None and gap < at:
                lo = gap + 1
            else:
                lo = start
        else:
            lo = 0
        hi = end
        if end < len(line):
            hi = next((i for i in range(end - 1, max(end - snap, at + len(phrase)) - 1, -1) if line[i] in " \t"), end)
        return ("…" if lo else "") + line[lo:hi] + ("…" if hi < len(line) else "")

    lines = [None, "", "short", "a b c d e f g h i j KEY l m n o p q r s t", "key" + "x" * 50, "x" * 50 + "key", "word " * 9 + "key", "no match in this long line of words", "ab cd " * 3 + "key" + " ef gh" * 5]
    got = column(spark, lines, lambda c: K.excerpt(c, "key", most=20, snap=5))
    assert got == [plain(x, "key") for x in lines]


def test_stems_and_terms(spark):
    assert column(spark, ["indexing", "classes", "class", "is", "handled", "Organization", "bus", None], K.stemmed) == ["index", "class", "class", "is", "handl", "organ", "bus", None]
    assert column(spark, ["How (does) the retry-loop work??", "", None], K.terms) == [["retry-loop", "work"], [], None]


def test_succession(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 100), (200, 200), (300, None)], "node long, next long")
    got = {r.node: (r.last, r.cyclic) for r in K.succession(links).collect()}
    assert got == {**{i: (40, False) for i in range(1, 40)}, **{n: (None, True) for n in (100, 101, 102, 200)}}
    assert K.succession(links.limit(0)).count() == 0


def test_curation(spark):
    ledger = spark.createDataFrame([("a", "h1", "v1"), ("b", "h2", "v2")], "path string, hash string, value string")
    edits = spark.createDataFrame([("k1", "a", "upsert", "h1", "n1"), ("k1", "a", "upsert", "h1", "n1"), ("k2", "a", "remove", "h1", None), ("k3", "b", "remove", "zz", None), ("k4", "c", "upsert", None, "n2"), ("k5", "d", "remove", None, None)], "key string, path string, op string, expected_hash string, value string")
    assert sorted((r.key, r.outcome) for r in K.curation_preview(ledger, edits).collect()) == [("k1", "applied"), ("k1", "replayed"), ("k2", "conflict"), ("k3", "stale"), ("k4", "applied"), ("k5", "missing")]
    assert sorted((r.path, r.value) for r in K.curate(ledger, edits).collect()) == [("a", "n1"), ("b", "v2"), ("c", "n2")]


def test_provenance(spark):
    a = V.claim(spark.createDataFrame([(1,), (2,)], "k int"), "docs", "s1", "complete")
    b = V.claim(spark.createDataFrame([(1,)], "k int"), "labels", "s2", "verifying")
    got = {r.k: (r.c, len(r._claims)) for r in V.derived(a, b, ["k"], "left").withColumn("c", V.coverage(F.col("_claims"))).collect()}
    assert got == {1: ("verifying", 2), 2: ("complete", 1)}
    with pytest.raises(ValueError):
        V.claim(a, "x", "y", "whole")
    ids = {"a": 1}
    lease = V.Lease(lambda: ids)
    lease.check()
    ids["b"] = 2
    with pytest.raises(V.SourceMoved):
        lease.check()


def test_bodies(spark):
    body = "/// Adds one.\n#[inline]\npub fn add(x: u8) -> u8 { x + 1 }"
    python = '@cached\ndef f(x):\n    """Say it.\n\n    More."""\n    return x'
    assert column(spark, [body, python, "", None], V.signature) == ["pub fn add(x: u8) -> u8", "def f(x)", "", ""]
    assert column(spark, [body, python, ""], V.first_doc_line) == ["Adds one.", "Say it.", None]
    assert column(spark, [body], lambda c: V.projected(c, "compact")) == ["pub fn add(x: u8) -> u8\nAdds one."]
    assert column(spark, ["aßc", "x"], lambda c: V.byte_slice(c, F.lit(1), F.lit(3))) == ["ß", ""]


def test_usages(spark):
    lines = spark.createDataFrame([("p", 1, "let a = Foo::new();"), ("p", 2, "// see Foo::new"), ("p", 3, 'x("Foo::new")'), ("p", 4, "use m::Foo;"), ("p", 5, "Foo()"), ("p", 6, "XFoo::y")], "path string, line_no int, line string")
    got = {r.line_no: r.confident for r in V.certain_usages(lines, "Foo").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    names = [("T", "rust"), ("u8", "rust"), ("u8", "go"), ("Foo", "rust")]
    df = spark.createDataFrame(names, "n string, l string").select(V.builtin_name(F.col("n"), F.col("l"), {"rust": ["u8"]}))
    assert [r[0] for r in df.collect()] == [True, True, False, False]

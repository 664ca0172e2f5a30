"""Markdown units, qualified calls, scopes, votes and searches against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import relations as R, scopes as C, search as S, units as U


def plain_units(text: str) -> list[tuple]:
    lines = text.split("\n")
    kinds, fence, top = [], "", lines[0].rstrip() == "---"
    for i, line in enumerate(lines):
        if top:
            kinds.append("top")
            top = not (i > 0 and line.rstrip() == "---")
        elif fence:
            kinds.append("code")
            if re.fullmatch(rf" {{0,3}}{fence[0]}{{{len(fence)},}}[ \t]*", line):
                fence = ""
        elif m := re.match(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})", line):
            kinds.append("code")
            fence = m[1]
        else:
            kinds.append("text")
    found = []
    for i, line in enumerate(lines):
        if kinds[i] != "text":
            continue
        if m := re.match(r" {0,3}(#{1,6})(?=[ \t]|$)(.*)", line):
            found.append((i + 1, len(m[1]), re.sub(r"(?:^|[ \t])#+[ \t]*$", "", m[2]).strip()))
        elif line.strip() and not re.match(r" {0,3}(>|[-*+] |=+\s*$|-+\s*$)", line) and i + 1 < len(lines) and kinds[i + 1] == "text":
            if re.match(r" {0,3}=+[ \t]*$", lines[i + 1]):
                found.append((i + 1, 1, line.strip()))
            elif re.match(r" {0,3}-+[ \t]*$", lines[i + 1]):
                found.append((i + 1, 2, line.strip()))
    out, stack = [], []
    for n, (at, level, heading) in enumerate(found, 1):
        while stack and stack[-1][0] >= level:
            stack.pop()
        end = next((a for a, x, _ in found[n:] if x <= level), len(lines) + 1) - 1
        out.append((n, level, [h for *_, h in stack] + [heading], stack[-1][1] if stack else None, at, end))
        stack.append((level, n, heading))
    return out


def test_sections(spark):
    r = random.Random(2)
    pieces = ["# One", "## Two ##", "###### deep", "#no", "Title", "=====", "Under", "---", "```", "# in code", "~~~", "````", "~~~~ rust", "```x", "   ```  ", "    ```", "``` a`b", "", "- item", "> said", "plain words", "### Three", "#"]
    texts = ["---\ntitle: x\n# not one\n---\n# A\n## B\n### C\n## D\n# E", "Only text", "", "T\n===\nU\n---\nV\n"]
    texts += ["\n".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(120)]
    rows = [(str(k), i + 1, x) for k, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    got = {}
    for x in U.sections(spark.createDataFrame(rows, "path string, line_no long, line string")).orderBy("path", "unit").collect():
        got.setdefault(x.path, []).append((x.unit, x.level, x.heading_path, x.parent, x.first_line, x.last_line))
    for k, t in enumerate(texts):
        assert got.get(str(k), []) == plain_units(t), t


@pytest.mark.parametrize("text,want", [
    ("# A\n```\n~~~\n# not\n```\n# B", ["A", "B"]),
    ("# Real\n\n```ruby\n# config\n# not\n```\n", ["Real"]),
    ("# Real\n\n~~~python\n# comment\n~~~\n", ["Real"]),
    ("# Real\n\n```ruby#6-7\n# phantom\n```\n## Sub\n", ["Real", "Real > Sub"]),
    ("# Real\n\n```\n# inside\n## also\n", ["Real"]),
    ("# Real\n\n```\n# inside\n`````\n## After\n", ["Real", "Real > After"]),
    ("# Real\n\n````\n# inside\n```\n# still\n````\n## After\n", ["Real", "Real > After"]),
    ("# Top\n\n```ruby\n# config\nend\n```\n\n## Real Sub\n", ["Top", "Top > Real Sub"]),
    ("# Real\n\n   ```\n# inside\n   ```\n## After\n", ["Real", "Real > After"]),
    ("# Real\n```\n``` not bare\n# inside\n```\n## After\n``` a`b\n# B", ["Real", "Real > After", "B"]),
    ("# Real\n    ```\n## After\n~~~~\n~~~\n# x\n~~~~~ \n# B", ["Real", "Real > After", "B"]),
])
def test_fences(spark, text, want):
    rows = [("p", i + 1, x) for i, x in enumerate(text.split("\n"))]
    got = U.sections(spark.createDataFrame(rows, "path string, line_no long, line string")).orderBy("unit").collect()
    assert [" > ".join(r.heading_path) for r in got] == want


def test_qualified_calls(spark):
    defs = [(1, "f", "src/a.rs", "T"), (2, "f", "src/b/mod.rs", "U"), (3, "f", "lib\\c.rs", "U"), (4, "g", "x/y.rs", None), (5, "h", "p/one.rs", "Same"), (6, "h", "q/two.rs", "Same"), (7, "f", "src/d.rs", "V")]
    calls = {1: ("f", "a::f", 1), 2: ("f", "crate::b::f", 2), 3: ("f", "c::f", 3), 4: ("f", "src::f", None), 5: ("f", "T::f", 1), 6: ("f", "U::f", None), 7: ("g", None, 4), 8: ("h", "Same::h", None), 9: ("f", "f", None), 10: ("f", None, None), 11: ("z", "a::z", None), 12: ("f", "x::V::f", 7), 13: ("h", "q::h", 6)}
    d = spark.createDataFrame(defs, "node long, name string, path string, owner string")
    c = spark.createDataFrame([(k, n, q) for k, (n, q, _) in calls.items()], "call long, name string, qualified string")
    got = {x.call: x.node for x in R.resolve_qualified(c, d).collect()}
    assert got == {k: want for k, (_, _, want) in calls.items() if want is not None}


def test_scopes(spark):
    paths = ["src", "src/a", "src2/a", "a/src", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    ask = lambda c: [x[0] for x in df.select(c).collect()]
    assert ask(C.in_path(F.col("p"), prefix="src//")) == [True, True, False, False, None]
    assert ask(C.in_path(F.col("p"), exact="src")) == [True, False, False, False, None]
    assert ask(C.in_path(F.col("p"), prefix="/")) == [True] * 5
    for bad in (lambda: C.in_path(F.col("p"), exact="a", prefix="b"), lambda: C.in_lane(F.col("p"), "other"), lambda: C.in_language(F.col("p"), "klingon", ["python"])):
        with pytest.raises(C.InvalidScope):
            bad()
    decisions = spark.createDataFrame([("a/b.tar.gz", "normal", 5, None, None), ("a/.env", "denied", 1, None, "x")], "path string, tier string, byte_len long, language string, reason string")
    assert [(x.path, x.extension) for x in C.admission_of(decisions, ".\\a\\b.tar.gz").collect()] == [("a/b.tar.gz", "gz")]
    assert C.admission_of(decisions, "a/.env").first().extension is None and C.admission_of(decisions, "nope").count() == 0


def test_language_vote(spark):
    def vote(**n):
        df = spark.createDataFrame([(k,) for k, c in n.items() for _ in range(c)], "language string")
        row = U.language_vote(df, {"javascript": "typescript"}, ["rust", "javascript", "typescript", "go"]).first()
        return row and tuple(row)

    assert vote(rust=3, go=1, json=50) == ("rust", 75, None, None)
    assert vote(rust=2, go=1) == ("rust", 66, "go", 33)
    assert vote(javascript=3, typescript=2, rust=4) == ("javascript", 55, "rust", 44)
    assert vote(javascript=2, typescript=2) == ("typescript", 100, None, None)
    assert vote(json=5) is None


def test_did_you_mean(spark):
    def plain(name, q):
        a, b = q.lower(), name.lower()
        if a in b or b in a:
            return 0
        beginning = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        most = max(len(q.encode()), len(name.encode()))
        shared = len(set(a) & set(b))
        return most - beginning if beginning else most - shared if shared else None

    names = ["resolve", "resolver", "res", "x", "Rest", "solve", "vlo", "éres", "zzz", "qq", "rslv"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((d, n) for n in names if len(n) >= 2 and (d := plain(n, "Resolv")) is not None)
    assert [(x.distance, x.name) for x in S.did_you_mean(df, "Resolv", limit=20).collect()] == want

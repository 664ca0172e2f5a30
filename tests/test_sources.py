"""Ignore rules against git, the commit log source, changed paths and budgets."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.sources import commit_log as L, ignore as G
from tessera.sources.snapshots import scan_tree


def rules_of(spark, files):
    return G.rules(spark.createDataFrame(files, "folder string, content string"))


def tree(spark, paths):
    return spark.createDataFrame([(p, False, len(p)) for p in paths], "path string, is_folder boolean, byte_len long")


def ignored(spark, paths, files):
    return {r.path for r in G.with_ignored(tree(spark, paths), rules_of(spark, files)).where("ignored").collect()}


@pytest.mark.parametrize("files,paths,want", [
    ([("", "*.log\n!keep.log")], ["a.log", "x/b.log", "keep.log", "x/keep.log", "a.txt"], {"a.log", "x/b.log"}),
    ([("", "build/\n!build/keep")], ["build/keep", "x/build/y", "build2/z", "y/build"], {"build/keep", "x/build/y"}),
    ([("", "/top\nin/side")], ["top", "x/top", "in/side", "x/in/side"], {"top", "in/side"}),
    ([("", "**/deep/*.x\na/**/b\nall/**")], ["deep/1.x", "p/q/deep/1.x", "deep/z/1.x", "a/b", "a/1/2/b", "all/y/z", "all2"], {"deep/1.x", "p/q/deep/1.x", "a/b", "a/1/2/b", "all/y/z"}),
    ([("", "*.o"), ("x", "!*.o"), ("x/y", "1.o")], ["1.o", "x/1.o", "x/y/1.o", "x/y/2.o"], {"1.o", "x/y/1.o"}),
    ([("", "[ab]?.c\n[!x]z\n\\#h\n\\!b\nsp\\ \ntrail  ")], ["a1.c", "c1.c", "xz", "yz", "#h", "!b", "sp ", "trail"], {"a1.c", "yz", "#h", "!b", "sp ", "trail"}),
    ([("", "\n# *\n   \n!")], ["a", "# *"], set()),
    ([("", "a.b")], ["aXb", "a.b"], {"a.b"}),
])
def test_rules(spark, files, paths, want):
    assert ignored(spark, paths, files) == want


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_rules_as_git_reads_them(spark, tmp_path):
    r = random.Random(4)
    names = ["a", "b", "ab", "c.x", "d.x", "build", "e1"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(250)})
    folders = {p.rsplit("/", n)[0] for p in paths for n in range(1, p.count("/") + 1)}
    paths = [p for p in paths if p not in folders]
    parts = ["a", "b", "*", "*.x", "**", "a*", "?", "[ab]", "[!a]", "build", "e1", "c.x", "*b"]
    cases = []
    for _ in range(25):
        files = []
        for folder in ["", *r.sample(sorted(folders), 3)]:
            lines = [r.choice(["", "", "!"]) + r.choice(["", "", "/"]) + "/".join(r.choice(parts) for _ in range(r.randint(1, 3))) + r.choice(["", "", "/"]) for _ in range(r.randint(1, 4))]
            files.append((folder, "\n".join(lines)))
        cases.append(files)
    want = {}
    for n, files in enumerate(cases):
        top = tmp_path / str(n)
        subprocess.run(["git", "init", "-q", str(top)], check=True)
        for p in paths:
            (top / p).parent.mkdir(parents=True, exist_ok=True)
            (top / p).write_text("")
        for folder, content in files:
            (top / folder / ".gitignore").write_text(content)
        out = subprocess.run(["git", "-C", str(top), "-c", "core.excludesFile=", "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True)
        want[n] = set(out.stdout.split("\n")) - {""}
    every = spark.createDataFrame([(f"{n}/{p}", False, 1) for n in want for p in paths], "path string, is_folder boolean, byte_len long")
    ruled = rules_of(spark, [(f"{n}/{folder}".rstrip("/"), content) for n, files in enumerate(cases) for folder, content in files])
    got = {n: set() for n in want}
    for row in G.with_ignored(every, ruled).where("ignored").collect():
        n, p = row.path.split("/", 1)
        got[int(n)].add(p)
    for n in want:
        assert got[n] == want[n], cases[n]


def test_dispositions(spark, tmp_path):
    rows = [("a/.git/x", 1), ("b/skip", 1), ("b/none", None), ("c" * 5000, 1), ("big", 200 << 20), ("code", 5 << 20), ("rows", 2 << 20), ("lock", 1), ("fine", 1), ("folder", 1)]
    entries = spark.createDataFrame([(p, p == "folder", n) for p, n in rows], "path string, is_folder boolean, byte_len long")
    got = {r.path[:6]: r.disposition for r in G.dispositions(entries, rules_of(spark, [("b", "s*")]), data=F.col("path") == "rows", lockfile=F.col("path") == "lock").collect()}
    assert got == {"a/.git": "hidden", "b/skip": "ignored", "b/none": "unreadable", "cccccc": "path_too_long", "big": "hard_skip", "code": "too_large", "rows": "too_large", "lock": "lockfile", "fine": "ingest"}
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f.txt").write_text("abc")
    assert [tuple(r) for r in G.entries(scan_tree(spark, str(tmp_path)), str(tmp_path)).collect()] == [("x/y/f.txt", False, 3)]
    assert G.dispositions(entries.limit(0), rules_of(spark, [("", "*")])).count() == 0


# -- the commit log

COMMITS = [(f"c{i}", 1_000_000_000 + i * 86_400 * 10, f"author {i % 3}", f"subject {i}\nmore") for i in range(40)]
FILES = [(f"c{i}", "M" if k else "A", f"dir/{k} {i}.txt") for i in range(40) for k in range(i % 4)]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("log") / "segments")
    L.register(spark)
    L.write(spark.createDataFrame(COMMITS, "oid string, unix long, author string, subject string"), spark.createDataFrame(FILES, "oid string, status string, path string"), at)
    return at


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def told(keep):
    own = {c[0]: c for c in COMMITS}
    return sorted((o, own[o][1], own[o][2], own[o][3].replace("\n", " "), s, p) for o, s, p in FILES if keep(own[o]))


def test_log_round_trip_and_filters(spark, log):
    df = spark.read.format("commit_log").load(log)
    assert rows(df) == told(lambda c: True)
    bound = COMMITS[25][1]
    recent = L.scan(spark, log, cutoff=bound)
    assert rows(recent) == told(lambda c: c[1] >= bound)
    assert rows(recent.where(F.col("unix") > bound)) == told(lambda c: c[1] > bound) and rows(recent) == told(lambda c: c[1] >= bound)
    assert rows(df.where(F.col("unix") < bound)) == told(lambda c: c[1] < bound)
    newest = {c[0] for c in sorted((c for c in COMMITS if int(c[0][1:]) % 4), key=lambda c: -c[1])[:7]}
    assert rows(L.newest(df, 7)) == told(lambda c: c[0] in newest)
    assert rows(L.scan(spark, log, max_commits=7)) == told(lambda c: c[0] in newest)
    capped = spark.read.format("commit_log").option("max_commits", 12).load(log)
    assert rows(L.newest(capped, 7)) == told(lambda c: c[0] in newest)


def test_segments_beyond_the_cutoff_are_not_read(spark, log):
    """A segment that lies wholly before the cut-off may even be damaged: nothing but its first line is looked at."""
    bound = COMMITS[30][1]
    old = [f for d, _, names in os.walk(log) for n in names if n.startswith("part-") for f in [os.path.join(d, n)] if int(open(f).readline().split()[2]) < bound]
    assert len(old) > 5
    texts = {f: open(f, "rb").read() for f in old}
    for f in old:
        with open(f, "wb") as out:
            out.write(texts[f].split(b"\n", 1)[0] + b"\ncommit x notanumber y\n")
    assert rows(L.scan(spark, log, cutoff=bound)) == told(lambda c: c[1] >= bound)
    assert len(L._Reader({"path": log, "cutoff": str(bound)}).partitions()) == len(L._Reader({"path": log}).partitions()) - len(old)
    df = L.scan(spark, log)
    with pytest.raises(Exception, match="notanumber"):
        df.collect()
    for f, text in texts.items():
        with open(f, "wb") as out:
            out.write(text)


def test_planning():
    s = [L.Segment("a", 3, 100, 80), L.Segment("b", 5, 79, 60), L.Segment("c", 4, 70, 50), L.Segment("d", 9, 40, 10)]
    names = lambda *a: "".join(x.path for x in L.planned(s, *a))
    assert names(None, None) == "abcd" and names(55, None) == "abc" and names(80, None) == "a"
    assert names(None, 3) == "a" and names(None, 4) == "abc" and names(None, 13) == "abcd" and names(None, 12) == "abc" and names(None, 0) == ""


def test_bad_logs(spark, tmp_path):
    L.register(spark)
    (tmp_path / "x.txt").write_text("no segment\n")
    with pytest.raises(Exception, match="segment's line"):
        spark.read.format("commit_log").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("commit_log").load().collect()


def test_changed_paths(spark):
    version = lambda **d: spark.createDataFrame(list(d.items()), "path string, digest string")
    base, head = version(a="1", b="1", c="1"), version(a="1", b="2", d="1")
    worktree = spark.createDataFrame([("a", "9", True, False), ("b", "2", True, False), ("e", "1", False, True), ("f", "1", False, False)], "path string, digest string, tracked boolean, staged boolean")
    assert rows(L.between(base, head)) == [("b", "modified"), ("c", "removed"), ("d", "added")]
    assert rows(L.uncommitted(head, worktree)) == [("a", "modified"), ("d", "removed"), ("e", "added")]
    assert rows(L.changed_paths(base, head, worktree)) == [("a", "modified"), ("b", "modified"), ("c", "removed"), ("d", "added"), ("e", "added"), ("f", "untracked")]
    assert "f" not in {r[0] for r in rows(L.changed_paths(base, head, worktree, include_untracked=False))}


def test_budgets(spark):
    refs = [("hot", f"p{i:04}", 10) for i in range(900)] + [("cold", "a", 5), ("cold", "b", 5000), ("cold", "c", 1)]
    kept, rest = L.within_budget(spark.createDataFrame(refs, "ref string, path string, byte_len long"), 1000, 70)
    assert rows(kept) == [("cold", "a", 5), *(("hot", f"p{i:04}", 10) for i in range(70))]
    assert rows(rest) == [("cold", 2, 5001), ("hot", 830, 8300)]

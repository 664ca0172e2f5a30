"""Fingerprints recomputed node by node, likeness by plain sets; chat windows held to their budget."""

import hashlib
import random
import re
import zlib
from math import ceil

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, merkle

from test_operators import sha


def plain_print(text: str) -> str:
    def node(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()[:16]

    sections = []
    for section in text.split("\n\n"):
        paragraphs = section.split("\n")
        marks = [",".join(f"{zlib.crc32(x.encode()):08x}" for x in re.split(r"(?<=[.!?,;:|sd])[ \t\n\x0b\f\r]+", p)) for p in paragraphs]
        nodes = [node(p) for p in paragraphs]
        sections.append(node("".join(nodes)) + "=" + "+".join(f"{a}/{b}" for a, b in zip(nodes, marks)))
    tree = "|".join(sections)
    return sha(sha(text) + tree) + ":" + tree


def plain_likeness(a: str, b: str) -> float:
    x, y = (set(re.findall("(?<=[/,])[0-9a-f]{8}", p)) for p in (a, b))
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y))


def test_tree_and_likeness(spark, docs, rows):
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    text = {i: t or "" for i, t in rows}
    order = sorted(text)
    for i, j in zip(order, order[1:] + order[:1]):
        k = len(text[i]) // 4
        edited = text[i][: len(text[i]) - k] + text[j][:k]
        own, new, following = (plain_print(x) for x in (text[i], edited, text[j]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, new)
        assert got[i].near_edited == pytest.approx(plain_likeness(own, new))
        assert got[i].near_next == pytest.approx(plain_likeness(own, following))


def test_merkle_odd_rows(spark):
    rows = [(None, "x. y"), (None, None), (1, "a. b"), (1, "a. b"), (1, "c"), (2, "d" * 40), (3, "s " * 200_000)]
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, fingerprint string, tie long")
    got = merkle.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    lone = [r for r in got if r.doc_id is None]
    assert all(r.near_next is None and r.near_edited == 1.0 for r in lone) and sorted(r.edited for r in lone) == ["", "x. y"]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 2 and sum(r.edited == got[0].edited for r in got) >= 1
    assert next(r for r in got if r.doc_id == 3).n_chars == 400_000


def test_differing_leads_to_edits(spark):
    r = random.Random(4)
    pairs = []
    for _ in range(60):
        sections = [[f"line {r.randrange(9)}." for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 5))]
        other = [[x if r.random() < 0.8 else x + " edited" for x in s] for s in sections]
        pairs.append(("\n\n".join(map("\n".join, sections)), "\n\n".join(map("\n".join, other)), [(i, j) for i, s in enumerate(sections) for j, x in enumerate(s) if x != other[i][j]]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i long, a string, b string")
    places = merkle.differing(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b")))
    for row in df.select("i", places.alias("d")).collect():
        assert [tuple(x) for x in row.d] == pairs[row.i][2]


def test_windows_keep_the_budget(spark):
    r = random.Random(6)
    turns = []
    for c in range(30):
        start = ["system"] * (c % 2)
        for t, role in enumerate(start + [("user", "assistant")[i % 2] for i in range(r.randint(1, 60))]):
            turns.append((c, t, role, "w" * r.choice([0, 1, 7, 30, 200, 900, 3000])))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).withColumn("window", F.lit("x"))
    tokens = {(c, t): ceil(len(x) / 4) + 4 for c, t, _, x in turns}
    for budget in (256, 1024):
        got = {}
        for row in chat.read(chat.windows(df, budget=budget)).collect():
            got.setdefault(row.conv_id, []).append(row)
        for c, windows in got.items():
            at = 0
            system = c % 2 == 1
            for w in sorted(windows, key=lambda w: w.window):
                new = len(w.turns)
                own = [tokens[c, t] for t in range(at, at + new)]
                lead = system and at > 0
                back = w.repeated - lead
                assert back <= chat.HISTORY and new >= 1
                repeated = sum(tokens[c, t] for t in range(at - back, at))
                assert repeated <= budget // chat.SHARE
                total = sum(own) + repeated + (tokens[c, 0] if lead else 0)
                assert total <= budget or new == 1
                at += new
            assert at == sum(x[0] == c for x in turns)

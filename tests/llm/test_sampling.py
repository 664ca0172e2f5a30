"""Importance resampling against a plain version: counts, weights, the exact cut, ranks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _bytes as B, importance


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target, share=(5, 100), least=20):
    found = {i: grams(t) for i, t in rows}
    s, t = (Counter(b for x in texts for b in grams(x)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = {}
    for i, (_, g) in found.items():
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in g)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[i][2], i) for i, (n, _) in found.items() if n >= least)
    for rank, (_, i) in enumerate(able[: share[0] * len(able) // share[1]], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


@pytest.fixture(scope="module")
def target(spark):
    return ["the cat sat on the MIT License", None, "", "long words 日本語 again " * 9, "under the mit license"]


@pytest.mark.parametrize("share", [(5, 100), (1, 2), (1, 1), (0, 1)])
def test_resample(spark, docs, rows, target, share):
    held = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = {r.id: (r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(docs, held, share=share).collect()}
    assert got == plain(rows, target, share)
    assert sum(v[3] is not None for v in got.values()) == share[0] * sum(grams(t)[0] >= 20 for _, t in rows) // share[1]


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(importance, "SPAN", 40)
    texts = ["one two three four " * 30, "", "x" * 300, "Ab-c  d e'f " * 20, " " * 200, "a b c d e f g h i j k l m n o p q r s t u v", "é ü " * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got, words = [Counter() for _ in texts], Counter()
    for bucket, owner, word_owner in importance.features(data, offsets):
        for b, o in zip(bucket.tolist(), owner.tolist()):
            got[o][b] += 1
        words.update(word_owner.tolist())
    assert got == [Counter(grams(t)[1]) for t in texts]
    assert [words[i] for i in range(len(texts))] == [grams(t)[0] for t in texts]


def test_checksums_of_long_words():
    text = b"a" + b"b" * 5000 + b"cd"
    data = np.frombuffer(text, np.uint8)
    starts, ends = np.array([0, 1, 5001, 0]), np.array([1, 5001, 5003, 5003])
    assert importance.checksums(data, starts, ends).tolist() == [zlib.crc32(text[a:b]) for a, b in zip(starts, ends)]
    crc = np.array([zlib.crc32(b"head")], np.uint32)
    for tail in (b"", b"x", b"tail" * 999):
        assert importance.shifted(crc, np.array([len(tail)]))[0] ^ zlib.crc32(tail) == zlib.crc32(b"head" + tail)


@pytest.mark.parametrize("k", [0, 1, 499, 500, 501, 999, 1000])
def test_exact_cut(spark, k):
    """Half of the rows share score and id; extremes of both signs; every cut has exactly k rows, the smallest ones."""
    keys = [(-(2**63), 5, 0), (2**63 - 1, -7, 1), (0, 2**63 - 1, 2), (0, -(2**63), 3)] + [(12, 9, i) for i in range(4, 504)] + [(i % 70_000 - 300, i * 7919 % 101, i) for i in range(504, 1000)]
    rows = spark.createDataFrame(keys, "a long, b long, row long")
    got = sorted(tuple(r) for r in rows.where(importance.smallest(rows, ["a", "b", "row"], k)).collect())
    assert got == sorted(keys)[:k]


def test_ranks(spark):
    rows = spark.createDataFrame([(i * 37 % 11, i) for i in range(300)], "a long, b long")
    got = sorted((r["rank"], r.a, r.b) for r in importance.ranked(rows, ["a", "b"]).collect())
    assert got == [(n, *x) for n, x in enumerate(sorted((i * 37 % 11, i) for i in range(300)), 1)]


def test_odd_rows(spark, empty):
    held = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(empty, held).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, long)] * 5 + [(7, long)] * 6 + [(3, None), (3, "")], "doc_id long, text string")
    out = importance.resample(docs, held.limit(0), share=(1, 2)).collect()
    assert len(out) == 13 and all(r.score is None and r["rank"] is None for r in out if r.id is None)
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3] and {r.id for r in out if r["rank"]} == {7}
    assert all(r.n_features == 87 for r in out if r.id != 3) and all((r.n_features, r.weight) == (0, 0) for r in out if r.id == 3)
    with pytest.raises(ValueError):
        importance.resample(docs, held, share=(3, 2))
    assert importance.resample(docs.select("doc_id", F.col("text").alias("t")), held.withColumnRenamed("text", "t"), text_col="t").count() == 13


def test_lower_casing_only_of_ascii():
    data = np.frombuffer("ÀB".encode(), np.uint8)
    assert B.LOWER[data].tobytes().decode() == "Àb"

"""The neighbours' vote against a plain one over all labelled vectors, and scores row by row."""

import numpy as np
import pytest

from tessera.llm import _bytes as B
from tessera.llm import quality


@pytest.fixture(scope="module")
def fitted(spark):
    path = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "labels.parquet")
    return quality.fit(docs, labels), docs.select("doc_id", "text").orderBy("doc_id").collect()


def test_vote_is_plain(fitted):
    model, rows = fitted
    texts = [r.text or "" for r in rows[:150]]
    raw = [t.encode() for t in texts]
    counts = quality.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = model.score(counts)
    labelled = [[int(x) for x in v] for v in model.vectors]
    for i, c in enumerate(counts):
        own = [int(x) for x in model.vectors_of(c[None])[0]]
        near = [sum(a * b for a, b in zip(own, v)) for v in labelled]  # exact, all of them
        least = sorted(near, reverse=True)[: quality.NEIGHBOURS][-1]
        sure = [j for j, x in enumerate(near) if x > least]
        tied = [j for j, x in enumerate(near) if x == least]
        weight = sum(max(near[j], 0) for j in sure)
        votes = sum(max(near[j], 0) * float(model.labels[j]) for j in sure)
        rest = quality.NEIGHBOURS - len(sure)
        some = sorted(float(model.labels[j]) for j in tied)
        total = weight + rest * max(least, 0)
        if total <= 0:
            assert got[i] == 0
            continue
        low, high = (votes + max(least, 0) * sum(some[:rest])) / total, (votes + max(least, 0) * sum(some[-rest:])) / total
        assert low - 1e-6 <= got[i] <= high + 1e-6


def test_scores_dont_depend_on_neighbouring_rows(fitted):
    model, rows = fitted
    raw = [(r.text or "").encode() for r in rows[:300]]
    counts = quality.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    whole = model.score(counts)
    one_by_one = np.array([model.score(c[None])[0] for c in counts])
    assert (whole == one_by_one).all()
    assert (model.score(counts[::-1])[::-1] == whole).all()


def test_counts_are_plain():
    text = "The cat, the CAT 12 the cat!"
    counts = quality.counts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    words = text.lower().split(" ")
    hashes = [int(B.slices_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) % quality.WORD_TERMS for w in words]
    assert counts[: quality.WORD_TERMS].sum() == len(words)
    assert all(counts[h] == hashes.count(h) for h in hashes)
    assert counts[quality.WORD_TERMS : quality.WORD_TERMS + quality.SHAPE_TERMS].sum() == len(words)

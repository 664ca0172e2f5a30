"""Votes by diagonal against a plain count, whole licenses, and places across merged diagonals."""

import random

import pytest

from tessera.llm import licenses
from tessera.llm.license_texts import TEXTS


def plain(text: str) -> tuple[set[str], float]:
    """Labels and score from every pair of k-grams of the text and of a template."""
    words = licenses.words_of(text)
    k = licenses.K
    labels, score = set(), 0.0
    every = [*((t, x, "phrase") for t, x in licenses.PHRASES.items()), *((t, x, licenses.COVERED) for t, x in licenses.PASSAGES.items()), *((t, x, licenses.WHOLE) for x, t in TEXTS.items())]
    for template, label, kind in every:
        own = licenses.words_of(template)
        grams = len(own) - k + 1
        lines: dict[int, set[int]] = {}
        for p in range(len(words) - k + 1):
            for q in range(grams):
                if words[p : p + k] == own[q : q + k]:
                    lines.setdefault(p - q, set()).add(q)
        spans: list[set[int]] = []
        places = 0
        before = None
        for d in sorted(lines):
            if before is None or d - before > licenses.GAP:
                spans.append(set())
            spans[-1] |= lines[d]
            places += len(lines[d]) == grams
            before = d
        best = max((len(s) / grams for s in spans), default=0.0)
        score = max(score, best)
        if places if kind == "phrase" else best >= kind:
            labels.add(label)
    return labels, score


def texts():
    r = random.Random(3)
    filler = [f"word{i}" for i in range(50)]
    out = ["", "one", "two words", " ".join(filler)]
    for text in [*TEXTS.values(), *licenses.PASSAGES, *licenses.PHRASES]:
        words = licenses.words_of(text)
        for edits in (0, 1, 4):
            w = list(words)
            for _ in range(edits):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 2)] = r.sample(filler, r.randint(0, 3))
            out.append(" ".join([*r.sample(filler, 5), *w, *r.sample(filler, 5)]))
    out.append(" ".join(r.choice([*TEXTS.values()]) for _ in range(4)))
    return out


def test_diagonals(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        labels, score = plain(t)
        assert got[i].labels == ",".join(sorted(labels)), t[:200]
        assert got[i].score == pytest.approx(score)


def test_whole_licenses_are_told_apart(spark):
    rows = list(enumerate(TEXTS.values()))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), label in zip(rows, TEXTS, strict=True):
        assert got[i] & set(TEXTS) == {label}


def test_odd_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (1, "under the MIT license"), (1, "under the MIT license"), (2, "under the mit license " * 20_000)]
    got = licenses.scan(spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id long, text string, row long, label string, score double")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted([("None", 0, 0, None, None, ""), ("None", 0, 0, None, None, ""), ("1", 0, 0, None, None, ""), ("1", 4, 1, 0, 0, "mit"), ("1", 4, 1, 0, 0, "mit"), ("2", 80_000, 20_000, 0, 79_996, "mit")], key=str)

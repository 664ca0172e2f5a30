"""Large families: close pairs confirmed first, open members against all; and sound hashes of words."""

import random

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.minhash import near_duplicates

from test_operators import components


def near_copies(n: int, seed: int = 1) -> list:
    """Near copies of one text, chains away from it, and copies of some."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(w)
    chain = list(base)
    for i in range(12):
        chain = list(chain)
        chain[5 * i] = f"y{i}"
        out.append(chain)
    texts = [" ".join(w) for w in out]
    texts += texts[:5]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1, 3, 128])
@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_large_family(spark, monkeypatch, block, k, num, den):
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", block)
    rows = near_copies(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=k, similarity=(num, den)).collect()}
    assert got == components(rows, k, num, den)


def test_forest_connects_what_pairs_connect():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(2, 30))
        m = int(r.integers(0, 60))
        a, b = np.sort(r.integers(0, n, (2, m)), 0)
        a, b = a[a != b], b[a != b]
        u, v = minhash._forest(a, b, n)
        assert set(zip(u.tolist(), v.tolist())) <= set(zip(a.tolist(), b.tolist())) and len(u) < n
        assert (minhash._labels(n, a, b)[1] == minhash._labels(n, u, v)[1]).all()


def thue_morse(n: int) -> tuple[str, str]:
    """Two complementary strings that polynomials modulo 2**64 don't tell apart."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


@pytest.mark.parametrize("n", [512, 1024, 4096, 8192])
def test_words_that_polynomials_confuse(spark, n):
    one, other = thue_morse(n)
    rows = [(1, f"{one} x y"), (2, f"{other} x y"), (3, f"{one} x y"), (4, f"{one} p q {other}"), (5, f"{other} p q {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=3, similarity=(85, 100)).collect()}
    assert got == components(rows, 3, 85, 100)


def chain(n: int) -> list:
    """Texts of which each shares just too little with the next: close by estimate, no true link."""
    r = random.Random(n)
    words = [f"w{r.randrange(10**9)}" for _ in range(24 * n + 200)]
    return [(i, " ".join(words[24 * i : 24 * i + 200])) for i in range(n)]


def test_a_chain_without_links_costs_its_close_pairs(spark, monkeypatch):
    """Twice the texts make twice the close pairs and twice the sets that are dealt out, not four times."""
    counts = []
    large = minhash._large

    def counted(sets, members, close, signed, lanes, num, den):
        confirmed, more = large(sets, members, close, signed, lanes, num, den)
        counts.append((close.count(), more.count(), confirmed.count()))
        return confirmed, more

    monkeypatch.setattr(minhash, "_large", counted)
    for n in (500, 1000, 2000):
        df = spark.createDataFrame(chain(n), "doc_id long, text string")
        out = near_duplicates(df, shingle=5, similarity=(4, 5))
        assert out.where("component_id <> doc_id").count() == 0
    assert all(linked == 0 for *_, linked in counts) and len(counts) == 3
    for (close, dealt, _), (close2, dealt2, _) in zip(counts, counts[1:]):
        assert 1.5 < close2 / close < 2.6 and 1.5 < dealt2 / dealt < 2.6
    assert all(dealt <= 3 * close for close, dealt, _ in counts)


def test_true_links_between_parts_that_the_forest_left_apart(spark, monkeypatch):
    """Small blocks, many near misses, some true links: the same components as all pairs."""
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 4)
    r = random.Random(11)
    words = [f"w{r.randrange(10**9)}" for _ in range(2200)]
    texts = []
    for i in range(70):
        w = words[24 * i : 24 * i + 200]
        texts.append(list(w))
        if r.random() < 0.5:
            for _ in range(r.choice([1, 2, 4, 6])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(w)
    rows = list(enumerate(" ".join(w) for w in texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(df, shingle=5, similarity=(4, 5)).collect()}
    assert got == components(rows, 5, 4, 5)

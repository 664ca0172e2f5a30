"""Whitening against numpy on the same distinct vectors."""

import math
import random

import numpy as np
import pytest

from tessera.llm import whitening


def plain(rows, k=4):
    xs = {i: [math.floor(256 * c) for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(x) for x in xs.values()}), object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((n * fit - s) / n).astype(float)
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    out = {}
    for i, x in xs.items():
        y = n * np.array(x, object) - s
        out[i] = (n, int((y * y).sum()), (y / n).astype(float) @ w / np.sqrt(e), e / np.trace(v))
    return out


def vectors(n, dims, seed=1):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(n, dims)) * np.linspace(0.3, 0.02, dims) @ np.linalg.qr(r.normal(size=(dims, dims)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)]
    return rows


@pytest.mark.parametrize("dims,tile", [(10, 32), (40, 16), (33, 32), (7, 2)])
def test_same_as_numpy(spark, dims, tile, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    rows = vectors(300, dims)
    bad = [(9000, None), (9001, []), (9002, [float("nan")] * dims), (9003, [None] + [0.0] * (dims - 1)), (9004, [float("-inf")] * dims), (9005, [0.5] * (dims + 1))]
    df = spark.createDataFrame([(i, v, 3, "s") for i, v in rows + bad], "vec_id long, embedding array<float>, x int, id string").repartition(3)
    got = whitening.whiten(df, tile=tile).collect()
    want = plain(rows)
    assert len(got) == 4 * len(rows)
    sign = {}
    for r in got:
        n, deviation, white, share = want[r.id]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        sign.setdefault(r.component, math.copysign(1, r.whitened * white[r.component - 1]))
        assert abs(r.whitened - sign[r.component] * white[r.component - 1]) < 1e-8
    assert len({r.identity_error for r in got}) == 1


def test_large_offset_and_exact_deviation(spark):
    """Entries far from 0 with small spread: nothing cancels, and deviations beyond 2**53 stay exact."""
    r = random.Random(2)
    rows = [(i, [1e3 + r.randint(0, 999) / 256, -3e3 + r.randint(0, 99) / 256, r.randint(0, 9) / 256]) for i in range(500)]
    rows.append((500, [1.2e4, 0.0, 0.0]))
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = plain(rows)
    assert len(got) == 3 * 501 and max(x.deviation for x in got) > 2**60
    for x in got:
        assert x.deviation == want[x.id][1] and abs(abs(x.whitened) - abs(want[x.id][2][x.component - 1])) < 1e-7


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(None, [0.5, 0.25])] * 3, schema)).collect()
    assert len(same) == 6 and all((x.id, x.n, x.deviation, x.whitened, x.explained, x.identity_error) == (None, 1, 0, None, None, None) for x in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(5)], schema)).collect()
    assert all((x.whitened is None) == (x.component == 2) for x in line) and line[0].identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [2.0**53, 0.0]), (2, [-(2.0**53), 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {x.deviation is None for x in huge} == {True, False} and len(huge) == 6


def test_tiles_cover_the_matrix(spark):
    rows = spark.createDataFrame([([i * 7919 % 13, i % 5, -i],) for i in range(100)], "x array<long>")
    x = np.array([r.x for r in rows.collect()])
    got = whitening.covariance(rows, 100, x.sum(axis=0).tolist(), tile=2)
    assert np.allclose(got, np.cov(x.T, bias=True), rtol=1e-12)


def test_query(spark):
    import __spark_entry__
    from test_oracles import DATA

    got = __spark_entry__.queries()["op13_embedding_whitening"](spark, DATA).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = plain(rows)
    assert len(got) == 4 * len(want)
    for r in got:
        assert r.deviation == want[r.vec_id][1] and abs(abs(r.whitened) - abs(want[r.vec_id][2][r.component - 1])) < 1e-6

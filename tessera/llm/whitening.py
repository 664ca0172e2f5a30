"""Whitening of embeddings: their covariance in tiles, its eigenvectors, and every vector along them.

Numbers. An entry c becomes the whole number floor(256 * c). The fit list holds
each distinct vector of whole numbers once. Sums are exact; centred entries are
(n * x - S) / n, of exact numerators, and are centred before they are multiplied.

Tiles. Dimensions are cut into blocks of ``TILE``. A task turns each batch of
vectors, a row block, into one matrix for each column block, and these are
shuffled by row block, as whole numbers of the narrowest type that holds them.
There the column blocks of a row block meet, are centred, and each pair, named by
a tile key, is multiplied; the products are added up by tile key, before the
shuffle and after it. The driver sees one matrix of all tiles (dimensions squared, however many vectors there are; ``MOST`` bounds
the dimensions), adds the mirror image, and finds eigenvalues and vectors.

Nulls, ties, repeats: a row whose vector is null, empty or holds a null or
non-finite entry goes, as do vectors that haven't the commonest length (the
longest of those equally common). Other rows come back once for each component,
with their id as it is (null, repeated). Copies count once in the fit, however
many there are: they fall together before the shuffle. With an empty table, or
none that is left, the result is empty. A component without variance has null
``whitened`` (and without any variance at all null ``explained``); a deviation
beyond a long is null. Entries beyond 2**53 / 256 lose digits as doubles do.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._tables import small_batches
from tessera.scratch import cut, fewer_files

SCALE = 256
TILE = 32
#: Vectors of a row block.
ROWS = 4096
COMPONENTS = 4
#: Dimensions the driver takes (a matrix of 128 MB).
MOST = 4096


@dataclass(frozen=True)
class Model:
    """What :func:`fit` learned; ``error`` is the largest departure of the whitened fit list's covariance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, x)``: the rows that count, their entries as whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is above infinity here
    rows = vectors.where(v.isNotNull() & usable & (F.size(v) > 0))
    sizes = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))))
    return rows.where(F.size(v) == (0 if sizes is None else sizes["size"])).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """(n * x - S) / n: the numerator in whole numbers, where they fit 64 bits."""
    high = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if n * high + max(map(abs, sums)) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / float(n)
    return ((n * x.astype(object) - np.array(sums, object)) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)**2; null beyond a long."""
    high = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if (n * high + max(map(abs, sums))) ** 2 * len(sums) < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [int(d) if d < 1 << 63 else None for d in (y * y).sum(axis=1).tolist()]


def _blocks(size: int, tile: int, kind: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Column blocks of row blocks: ``(part, nth, block, body)``. ``part`` and ``nth`` name the row block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for got in batches:
            for at in range(0, got.num_rows, ROWS):
                rows = got.slice(at, ROWS)
                x = _matrix(rows.column("x"), size).astype(kind)
                bodies = [np.ascontiguousarray(x[:, i : i + tile]).tobytes() for i in range(0, size, tile)]
                k = len(bodies)
                yield pa.RecordBatch.from_arrays([pa.array([rows.column("part")[0].as_py()] * k, pa.int32()), pa.array([nth] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(bodies, pa.binary())], names=["part", "nth", "block", "body"])
                nth += 1

    return run


def _products(n: int, sums: list[int], tile: int, kind: np.dtype) -> Callable[[pa.Table], pa.Table]:
    """Products of each pair of a row block's column blocks, centred first: ``(tile, place, value)``."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = []
        for body in rows.sort_by("block")["body"].to_pylist():
            own = sums[len(blocks) * tile : (len(blocks) + 1) * tile]
            blocks.append(_centred(np.frombuffer(body, kind).reshape(-1, len(own)).astype(np.int64), n, own))
        keys = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
        found = [(blocks[i].T @ blocks[j]).ravel() for i, j in keys]
        tiles = np.repeat([i * len(blocks) + j for i, j in keys], [len(f) for f in found])
        return pa.table({"tile": tiles, "place": np.concatenate([np.arange(len(f)) for f in found]), "value": np.concatenate(found)})

    return run


def covariance(listed: DataFrame, n: int, sums: list[int], kind: str = "int64", tile: int = TILE) -> np.ndarray:
    """The covariance of the fit list ``(x)``, divisor ``n``; ``kind`` is a type that holds all entries."""
    small_batches(listed.sparkSession)
    size, kind = len(sums), np.dtype(kind)
    named = listed.select("x").withColumn("part", F.spark_partition_id())  # the table fixes which rows a part has
    blocks = named.mapInArrow(_blocks(size, tile, kind), "part int, nth long, block int, body binary")
    products = blocks.groupBy("part", "nth").applyInArrow(_products(n, sums, tile, kind), "tile long, place long, value double")
    summed = products.groupBy("tile", "place").agg(F.sum("value").alias("value"))
    out, many = np.zeros((size, size)), -(-size // tile)
    for t, place, value in summed.toPandas().itertuples(index=False):  # at most half the matrix and its diagonal tiles
        i, j = divmod(int(t), many)
        width = min(tile, size - j * tile)
        row, column = i * tile + place // width, j * tile + place % width
        out[row, column] = out[column, row] = value / n
    return out


def _totals(listed: DataFrame) -> tuple[int, list[int], str]:
    """Number of vectors, sums of their entries, and the narrowest type that holds all of them."""
    n, low, high = listed.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return 0, [], "int8"
    kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low <= high <= np.iinfo(k).max)
    term = F.col("col") if n * max(abs(low), abs(high)) < 1 << 63 else F.col("col").cast("decimal(20, 0)")
    summed = listed.select(F.posexplode("x")).groupBy("pos").agg(F.sum(term).alias("total")).orderBy("pos").collect()  # a row a dimension
    return n, [int(r.total) for r in summed], kind


def fit(rows: DataFrame, *, components: int = COMPONENTS, tile: int = TILE) -> Model | None:
    """Sums, eigenvalues (falling) and unit eigenvectors of the distinct vectors of ``rows`` (id, x); None of no rows."""
    listed = cut(fewer_files(rows.select("x").distinct()), "fit-list")
    n, sums, kind = _totals(listed)
    if not n:
        return None
    if len(sums) > MOST:
        raise ValueError(f"vectors of more than {MOST} dimensions")
    v = covariance(listed, n, sums, kind, tile)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy()
    trace = float(np.trace(v))
    values[values <= trace * len(sums) * np.finfo(float).eps] = 0
    model = Model(n, sums, values, vectors, trace)
    return Model(n, sums, values, vectors, trace, _identity_error(listed, model))


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Vectors along the components that have variance, each in units of its deviation."""
    some = model.values > 0
    return _centred(x, model.n, model.sums) @ (model.vectors[:, some] / np.sqrt(model.values[some]))


def _identity_error(listed: DataFrame, model: Model) -> float | None:
    """Measured on the fit list: means and centred products of each batch, merged exactly as two samples are."""
    k = int((model.values > 0).sum())
    if not k:
        return None

    def merge(a, b):
        (n, mean, products), (m, other, more) = a, b
        by = other - mean
        return n + m, mean + by * (m / (n + m)), products + more + np.outer(by, by) * (n * m / (n + m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for got in batches:
            if got.num_rows:
                w = _whitened(_matrix(got.column("x"), len(model.sums)), model)
                c = w - w.mean(axis=0)
                part = (len(w), w.mean(axis=0), c.T @ c)
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].ravel().tolist()])], names=["n", "mean", "products"])

    total = None
    for row in listed.select("x").mapInArrow(run, "n long, mean array<double>, products array<double>").toLocalIterator():  # a row a task
        part = (row.n, np.array(row["mean"]), np.array(row.products).reshape(k, k))
        total = part if total is None else merge(total, part)
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """Each of ``rows`` (id, x) along each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, some = len(model.values), model.values > 0
        share = [float(e) / model.trace if model.trace > 0 else None for e in model.values]
        for got in batches:
            m = got.num_rows
            x = _matrix(got.column("x"), len(model.sums))
            w = np.zeros((m, k))
            w[:, some] = _whitened(x, model)
            every = np.repeat(np.arange(m), k)
            number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
            deviation = pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(every))
            yield pa.RecordBatch.from_arrays(
                [got.column("id").take(pa.array(every)), pa.array(number), pa.array(np.full(m * k, model.n)), deviation, pa.array(w.ravel(), mask=np.tile(~some, m)), pa.array(share * m, pa.float64()), pa.array([model.error] * (m * k), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _OUT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component."""
    rows = whole(vectors, id_col, vector_col)
    model = fit(rows, components=components, tile=tile)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    return transform(rows, model)

"""Quality scores by nearest neighbours among labelled latent-semantic vectors.

Terms of a text are its words and their shapes (upper and lower case, digits and
marks, runs collapsed), hashed, and terms for how much of it repeats the words
just before: ``DIMENSIONS`` counts. Counts are damped, idf
weighted and projected on the leading ``RANK`` singular vectors of the labelled
sample. The labelled vectors are broadcast; every document is compared with all
of them, block by block, and its ``NEIGHBOURS`` nearest vote with their
similarity as weight.

Bounds. The model is fitted on at most ``SAMPLE`` labelled rows (the least
hashes of their ids), so what is gathered and broadcast has a fixed size: SAMPLE
x RANK and DIMENSIONS x RANK floats, some 1.5 MB. Scoring covers every document
in one pass without a shuffle.

Labels of a document that occurs repeatedly are averaged. Rows whose crc32 of
the id (as text) is divisible by 5 are held out. Labels, ids, language and
source are never inputs of a score.

Projections and cosines are taken between whole numbers (``GRID`` steps to one),
whose products and sums are exact, so a score depends on its text alone and not
on the rows that are scored beside it.

Nulls, ties, repeats: a null, empty or wordless text has no vector and scores 0.
A null label teaches nothing; a null id can't be held out (false) and still gets
a score. Equal texts get equal scores. A very long text is counted whole, in one
task; an empty table gives an empty result. Without usable labels every text with
words scores 1 (nothing is rejected). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import _bytes as B
from tessera.llm._tables import small_batches, widened

SAMPLE = 3000
WORD_TERMS = 1024
SHAPE_TERMS = 1024
#: Words that repeat the word before them, and the one before that, by their share of the text.
REPEAT_TERMS = 16
DIMENSIONS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
#: Words say what a text is about; shapes and repeats say more of how it is made.
WORD_WEIGHT = 0.3
RANK = 48
NEIGHBOURS = 25
BLOCK = 256
#: Steps to one: sums of products stay below 2**24, so single precision holds them exactly.
GRID = 2048
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of every text: a matrix of texts x DIMENSIONS."""
    starts, ends, first = B.words(data, offsets)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    hashes = B.slices_hash(B.LOWER[data], starts, ends)
    word = hashes % np.uint64(WORD_TERMS)
    shape = _SHAPE[data]
    keep = np.zeros(len(data) + 1, bool)
    keep[1:-1] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep[:-1])])
    forms = B.slices_hash(shape[keep[:-1]], at[starts], at[ends]) % np.uint64(SHAPE_TERMS)
    cells = np.concatenate([row * DIMENSIONS + word.astype(np.int64), row * DIMENSIONS + WORD_TERMS + forms.astype(np.int64)])
    out = np.bincount(cells, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)
    size = np.maximum(np.diff(first), 1)
    for lag in (1, 2):
        again = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
        share = np.bincount(row[lag:][again], minlength=n) / size
        level = np.clip(np.ceil(np.log2(np.maximum(share, 2.0**-9)) + 8), 0, 8).astype(np.int64)  # doublings above 1/256
        base = WORD_TERMS + SHAPE_TERMS + 8 * (lag - 1)
        for i in range(8):  # each level reached is a term, as frequent as the text is long
            out[:, base + i] = np.where(level > i, np.expm1(np.sqrt(size).clip(max=20)), 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _grid(x: np.ndarray) -> np.ndarray:
    return np.rint(x * np.float32(GRID)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """What scoring needs: idf, the projection, the labelled vectors and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, term_counts: np.ndarray, labels: np.ndarray) -> Model:
        n = len(labels)
        idf = np.log((1 + n) / (1 + (term_counts > 0).sum(0))).astype(np.float32) + 1
        idf[:WORD_TERMS] *= WORD_WEIGHT
        weighted = _unit(np.log1p(term_counts) * idf)
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        basis = _grid(np.ascontiguousarray(vectors[:, ::-1][:, :RANK], np.float32))
        return cls(idf, basis, _grid(_unit(_grid(weighted) @ basis)), labels.astype(np.float32))

    def vectors_of(self, term_counts: np.ndarray) -> np.ndarray:
        return _grid(_unit(_grid(_unit(np.log1p(term_counts) * self.idf)) @ self.basis))

    def score(self, term_counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(term_counts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(term_counts), BLOCK):
            block = term_counts[i : i + BLOCK]
            near = self.vectors_of(block) @ self.vectors.T / np.float32(GRID * GRID)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64)
            total = weight.sum(1)
            votes = (weight * self.labels[best]).sum(1)
            out[i : i + BLOCK] = np.divide(votes, total, out=np.zeros(len(block)), where=total > 0)
        return np.clip(out, 0, 1)


_VECTORS = pa.schema([("label", pa.float64()), ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.float32()))])
_SCORED = pa.schema([("row", pa.int64()), ("score", pa.float64())])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        for i in range(0, got.num_rows, BLOCK):
            part = got.slice(i, BLOCK)
            found = counts(*B.view(part.column("text")))
            at = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array([x[a] for x, a in zip(found, at, strict=True)], pa.list_(pa.float32()))], schema=_VECTORS)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model from at most ``sample`` labelled rows that aren't held out; None without any."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("id"), "id").limit(sample))  # at most ``sample`` pairs of numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = texts.join(chosen, "id").orderBy(F.xxhash64("text"), "id").limit(sample).select("label", "text").mapInArrow(_count_rows, "label double, at array<int>, count array<float>")
    rows = found.toArrow()
    if not rows.num_rows:
        return None
    dense = np.zeros((rows.num_rows, DIMENSIONS), np.float32)
    for x, at, n in zip(dense, rows["at"].to_pylist(), rows["count"].to_pylist(), strict=True):
        x[at] = n
    return Model.fit(dense, rows["label"].to_numpy())


def score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` (a column of the score's name is replaced) with a score from 0 to 1 (higher: label 1 is likelier)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs, schema = widened(docs, {name: "double"})
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for got in batches:
            data, offsets = B.view(got.column(text_at).cast(pa.string()))
            out = np.zeros(got.num_rows)
            for i in range(0, got.num_rows, BLOCK):
                a, b = offsets[i], offsets[min(i + BLOCK, got.num_rows)]
                found = counts(data[a:b], offsets[i : i + BLOCK + 1] - a)
                out[i : i + BLOCK] = (found.sum(1) > 0) if own is None else own.score(found)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema)

"""Reading inputs and running Python stages for the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Bytes of an Arrow batch, so that long texts don't fill a worker.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bounds the bytes of an Arrow batch in this session; tables of whole texts need it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the values end to end and the length of each list."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from rows sorted by ``keys``.

    Groups that end in a batch go out together; only the last, which the next
    batch may continue, is held back.
    """
    held: list[pa.RecordBatch] = []
    for got in batches:
        if not got.num_rows:
            continue
        rows = pa.Table.from_batches([*held, got])
        last = np.ones(rows.num_rows, bool)
        for k in keys:
            column = rows[k].to_numpy()
            last &= column == column[-1]
        cut = rows.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Indices at which a new group begins in sorted columns, and the number of rows at the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        same = np.ones(n - 1, bool)
        for c in columns:
            same &= c[1:] == c[:-1]
        new[1:] = ~same
    return np.append(np.flatnonzero(new), n)


def widened(df: DataFrame, added: dict[str, str]) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns of the added names (they are replaced), and its schema with them."""
    df = df.drop(*[c for c in df.columns if c.lower() in {a.lower() for a in added}])
    fields = [T.StructField(n, T._parse_datatype_string(k)) for n, k in added.items()]
    return df, T.StructType([*df.schema.fields, *fields])

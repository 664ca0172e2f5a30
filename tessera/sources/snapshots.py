"""Snapshots of tables: written whole, verified by digest, promoted by a pointer, skipped when unchanged."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class Refused(RuntimeError):
    """A ceiling was crossed or a snapshot doesn't hold what was written."""


def digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: number, sum and xor of row hashes."""
    code = F.xxhash64(*sorted(df.columns))
    row = df.select(code.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first()
    return f"{row.n}:{row.s}:{row.x}"


def write(df: DataFrame, root: str, *, known: str | None = None, verify: bool = True) -> tuple[str, str]:
    """(path, digest). Written to a folder of its own, read again and compared; with an equal ``known`` digest nothing is written."""
    marked = digest(df)
    if marked == known:
        return "", marked
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if verify and digest(df.sparkSession.read.schema(df.schema).parquet(path)) != marked:
        raise Refused(f"{path} doesn't hold the rows that were written")
    return path, marked


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A snapshot of just this schema; others are refused, not coerced."""
    found = spark.read.parquet(path).schema
    if [(f.name, f.dataType) for f in found] != [(f.name, f.dataType) for f in schema]:
        raise Refused(f"{path} has another schema: {found.simpleString()}")
    return spark.read.schema(schema).parquet(path)


def scan_tree(spark: SparkSession, root: str, *, most_files: int = 200_000, most_bytes: int = 16 << 30, pattern: str | None = None) -> DataFrame:
    """Files below a folder (path, byte_len, modified, content); refused beyond the ceilings, which metadata decide."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if size.n > most_files or size.bytes > most_bytes:
        raise Refused(f"{size.n} files, {size.bytes} bytes")
    return found.select("path", F.col("length").alias("byte_len"), F.col("modificationTime").alias("modified"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """Content as text without a byte order mark; what isn't UTF-8 has null text."""
    bare = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    return files.withColumn("text", F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")))


def promote(spark: SparkSession, root: str, path: str, marked: str, *, complete: bool, stable: bool) -> None:
    """Makes a snapshot the current one of a folder, if it was read completely, its sources stood still and it holds its digest.

    The pointer is a row of a table of promotions; the newest row that was fully
    written counts, so a writer that dies leaves the one before.
    """
    if not (complete and stable):
        raise Refused(f"{path} isn't {'complete' if not complete else 'stable'}")
    if digest(spark.read.parquet(path)) != marked:
        raise Refused(f"{path} doesn't hold the rows of its digest")
    row = spark.createDataFrame([(path, marked)], "path string, digest string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/promotions")


def current(spark: SparkSession, root: str) -> str | None:
    """The path of the newest promoted snapshot."""
    schema = "path string, digest string, at timestamp"
    try:
        row = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/promotions").agg(F.max_by("path", "at").alias("path")).first()
    except AnalysisException:
        return None
    return row.path

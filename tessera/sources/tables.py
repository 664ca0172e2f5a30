"""Adapters from tables of the data folder to the engine's shapes.

files(path, language, source, content, byte_len), lines(path, line_no, line, n_lines),
commits(oid, ts, author), commit_files(oid, path), symbols(path, name, kind,
depth, line), access(path, ts, session). Only the columns a query asks for are
read: every adapter is a projection that Catalyst prunes into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select("doc_id", path.alias("path"), F.col("lang").alias("language"), "source", F.coalesce("text", F.lit("")).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("byte_len"))


def lines(files_: DataFrame) -> DataFrame:
    """A row for each line, numbered from 1, without a closing carriage return, with the number of the file's lines."""
    every = files_.select("path", F.split("content", "\n").alias("_l")).select("path", F.size("_l").cast("long").alias("n_lines"), F.posexplode("_l").alias("at", "line"))
    return every.select("path", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"), "n_lines")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"))


def part_path():
    return F.concat_ws("/", F.lower("p_type"), "p_brand")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (oid, path): the paths that each order's parts lie in."""
    parts = table(spark, sf_dir, "part").select("p_partkey", part_path().alias("path"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("oid"), "path").distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(part_path().alias("path"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_size").cast("long").alias("depth"), F.col("p_partkey").alias("line"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("path"), F.col("ts"), F.col("user_id").alias("session"), "event_type")

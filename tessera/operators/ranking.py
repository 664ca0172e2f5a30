"""A global row number without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.scratch import cut


def global_row_number(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with each row's place, from 1, in the order of ``keys``, and the number of rows as ``<name>_of``.

    Rows are range-partitioned and numbered within their partition; the only
    global window is over one row a partition. The dealt rows are written once,
    so both passes see the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_part")
    before = sizes.select("_part", (F.sum("_n").over(every) - F.col("_n")).alias("_before"), F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")

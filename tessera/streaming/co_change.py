"""Co-change as a stream: a ledger with a fence for each batch, and state in buckets of pairs.

Input is a stream of commits (oid, ts, paths). A batch writes the ledger rows of
its new commits (a folder a batch, overwritten when it runs again) and new
versions of only those buckets of the state whose pairs it touches. It reads, of
each bucket, the newest version of an *earlier* batch, so a batch that runs again
starts from the same state and writes the same folders; a commit that an earlier
batch has is left out. The fence, written last, says which batches count.

Weights are kept as of a fixed day, which decay only scales, so time that passes
touches no bucket: sum(base * 2 ** ((ts - ANCHOR) / half-life)). Pairs that lose
commits to the window are added up anew from the ledger, so nothing drifts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators import history as H

BUCKETS = 64
#: The day, in Unix seconds, that kept weights refer to.
ANCHOR = 946_684_800
_LEDGER = "oid string, a string, b string, base double, ts timestamp"
_STATE = "a string, b string, shared long, weight double, last_ts timestamp"


def _bucket():
    return F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)).cast("int")


def _scaled(half_life: float):
    return F.col("base") * F.pow(F.lit(2.0), (F.unix_timestamp("ts") - F.lit(ANCHOR)) / F.lit(86_400.0 * half_life))


class CoChange:
    """The ledger, state and fences below ``root``, for a window of ``days``."""

    def __init__(self, spark: SparkSession, root: str, *, days: int = 730, half_life: float = 30.0, most_files: int = 200) -> None:
        self.spark, self.root, self.days, self.half_life, self.most = spark, root.rstrip("/"), days, half_life, most_files

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of a table with the batch that wrote them; none if there is no table."""
        try:
            found = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return found if before is None else found.where(F.col("batch") < before)

    def _until(self, before: int | None):
        """The newest fence before a batch: (batch, until), the end of the window then."""
        return self._read("fence", "until timestamp", before).agg(F.max(F.struct("batch", "until")).alias("f")).first().f

    def state(self, before: int | None = None) -> DataFrame:
        """(a, b, shared, weight, last_ts) as of the fenced batches, weights as of ANCHOR."""
        fence = self._until(before)
        if fence is None:
            return self.spark.createDataFrame([], _STATE)
        versions = self._read("state", f"{_STATE}, bucket int").where(F.col("batch") <= fence.batch)
        # a folder of a bucket that has become empty counts too, so versions are told by the list of touched buckets
        touched = self._read("touched", "bucket int").where(F.col("batch") <= fence.batch).groupBy("bucket").agg(F.max("batch").alias("batch"))
        return versions.join(F.broadcast(touched), ["bucket", "batch"], "left_semi").select("a", "b", "shared", "weight", "last_ts")  # at most BUCKETS rows

    def weighted(self, now: str) -> DataFrame:
        """The state with weights as of ``now``."""
        days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.lit(ANCHOR)) / F.lit(86_400.0 * self.half_life)
        return self.state().withColumn("weight", F.col("weight") * F.pow(F.lit(2.0), -days))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of commits (oid, ts, paths); running it again changes nothing."""
        fence = self._until(number)
        before = self._read("ledger", _LEDGER, number)
        known = self._read("commits", "oid string, ts timestamp", number)
        fresh = batch.select(F.col("oid").cast("string").alias("oid"), "ts", "paths").dropDuplicates(["oid"]).join(known.select("oid"), "oid", "left_anti")
        self._write(fresh.select("oid", "ts"), "commits", number)
        log = fresh.select("oid", "ts", F.explode(F.array_distinct("paths")).alias("path"))
        self._write(H.ledger(log, most_files=self.most).select("oid", "a", "b", "base", "ts"), "ledger", number)
        incoming = self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger/batch={number}")
        newest = self.spark.read.schema("oid string, ts timestamp").parquet(f"{self.root}/commits/batch={number}").agg(F.max("ts")).first()[0]
        was = None if fence is None else fence.until
        until = max(x for x in (was, newest) if x is not None) if was or newest else None
        since = F.lit(until) - F.make_dt_interval(F.lit(self.days))
        inside = F.col("ts") > since
        gone = before.where(~inside & (F.col("ts") > F.lit(was) - F.make_dt_interval(F.lit(self.days)))) if was is not None else before.where("false")
        lost = gone.select("a", "b").distinct()
        own = incoming.where(inside)
        touched = own.select(_bucket().alias("bucket")).unionByName(gone.select(_bucket().alias("bucket"))).distinct()
        old = self.state(number).withColumn("bucket", _bucket()).join(F.broadcast(touched), "bucket", "left_semi")  # at most BUCKETS rows
        kept = old.join(lost, ["a", "b"], "left_anti").select("a", "b", "shared", "weight", "last_ts")
        again = before.join(lost, ["a", "b"], "left_semi").where(inside).select("a", "b", "base", "ts")
        added = again.unionByName(own.select("a", "b", "base", "ts")).select("a", "b", F.lit(1).cast("long").alias("shared"), _scaled(self.half_life).alias("weight"), F.col("ts").alias("last_ts"))
        new = kept.unionByName(added).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("weight").alias("weight"), F.max("last_ts").alias("last_ts"))
        new.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/state/batch={number}")
        self._write(touched, "touched", number)
        if until is not None:
            self._write(self.spark.createDataFrame([(until,)], "until timestamp"), "fence", number)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")

    def sink(self, commits: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Applies a stream of commits batch by batch."""
        return commits.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def cold(commits: DataFrame, *, days: int = 730, half_life: float = 30.0, most_files: int = 200) -> DataFrame:
    """The state that all ``commits`` (oid, ts, paths) give at once, weights as of ANCHOR."""
    single = commits.select(F.col("oid").cast("string").alias("oid"), "ts", "paths").dropDuplicates(["oid"])
    newest = single.agg(F.max("ts").alias("until"))
    log = single.crossJoin(F.broadcast(newest)).where(F.col("ts") > F.col("until") - F.make_dt_interval(F.lit(days))).select("oid", "ts", F.explode(F.array_distinct("paths")).alias("path"))
    rows = H.ledger(log, most_files=most_files)
    return rows.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(_scaled(half_life)).alias("weight"), F.max("ts").alias("last_ts"))

"""Change and access streams: coalescing, sessions, incremental access state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def debounced(changes: DataFrame, *, quiet: Column | str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of changes (path, op, ts): one row a path and burst, with its first and last time and number of events.

    A burst ends after ``quiet`` without an event; the gap may be an expression.
    """
    windowed = changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("burst"), "path")
    return windowed.agg(F.count("*").alias("events"), F.max_by("op", "ts").alias("op")).select("path", F.col("burst.start").alias("first_ts"), F.col("burst.end").alias("end_ts"), "events", "op")


def once(events: DataFrame, key: str, *, late: str = "10 minutes") -> DataFrame:
    """Events without replays of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each path of a batch; of one time the greater op."""
    return changes.groupBy("path").agg(F.max(F.struct("ts", "op")).alias("c")).select("path", F.col("c.ts").alias("ts"), F.col("c.op").alias("op"))


def merge_access(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Access state (path, hits, last_ts) with the hits of a batch (path, ts) added."""
    fresh = batch.groupBy("path").agg(F.count("*").alias("hits"), F.max("ts").alias("last_ts"))
    both = state.select("path", "hits", "last_ts").unionByName(fresh)
    return both.groupBy("path").agg(F.sum("hits").alias("hits"), F.max("last_ts").alias("last_ts"))


def state_sink(events: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Keeps access state below ``root``, a folder a batch.

    A batch reads the state of the batch before and writes its own, so a batch
    that runs again writes the same folder anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("path", "ts")
        if number == 0:
            state = spark.createDataFrame([], "path string, hits long, last_ts timestamp")
        else:
            state = spark.read.parquet(f"{root}/batch={number - 1}")
        merge_access(state, fresh).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def fenced(mutations: DataFrame, generations: DataFrame) -> DataFrame:
    """Mutations (path, generation) that aren't older than what is published for the path."""
    seen = generations.select("path", F.col("generation").alias("_published"))
    return mutations.join(seen, "path", "left").where(F.col("_published").isNull() | (F.col("generation") >= F.col("_published"))).drop("_published")


def reconcile(known: DataFrame, disk: DataFrame) -> DataFrame:
    """Changes (path, op) that make known files (path, size, modified) those on disk: the full scan after a gap in the events."""
    a = known.select("path", F.struct("size", "modified").alias("_a"))
    b = disk.select("path", F.struct("size", "modified").alias("_b"))
    op = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "modify")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).where("op IS NOT NULL")


def stale(asked: DataFrame, known: DataFrame, disk: DataFrame) -> DataFrame:
    """Of the paths asked for those that must be read anew before an answer; with a few asked, both sides are semi-joined first."""
    few = asked.select("path").distinct()
    return reconcile(known.join(few, "path", "left_semi"), disk.join(few, "path", "left_semi"))


def changed_content(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch (path, hash) whose content isn't what is known."""
    return batch.join(known.select("path", F.col("hash").alias("_known")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("_known"))).drop("_known")


def session_seen(seen: DataFrame, batch: DataFrame) -> DataFrame:
    """What each session has fetched, (session, path, reads, tokens, last_ts), with a batch (session, path, tokens, ts) added."""
    fresh = batch.groupBy("session", "path").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_ts"))
    both = seen.select("session", "path", "reads", "tokens", "last_ts").unionByName(fresh)
    return both.groupBy("session", "path").agg(F.sum("reads").alias("reads"), F.sum("tokens").alias("tokens"), F.max("last_ts").alias("last_ts"))


def session_summary(seen: DataFrame) -> DataFrame:
    """Per session of :func:`session_seen`: reads, files, reads of files it had already, tokens and last time."""
    return seen.groupBy("session").agg(F.sum("reads").alias("reads"), F.count("*").alias("files"), F.sum(F.col("reads") - 1).alias("hits"), F.sum("tokens").alias("tokens"), F.max("last_ts").alias("last_ts"))


def bounded_queue(batch: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The first ``capacity`` events (ts, id) of a batch, and one row counting those taken and dropped."""
    taken = batch.orderBy("ts", "id").limit(capacity)
    counts = batch.agg(F.least(F.count("*"), F.lit(capacity).cast("long")).alias("taken"), F.greatest(F.count("*") - capacity, F.lit(0).cast("long")).alias("dropped"))
    return taken, counts


def unverified(entries: DataFrame, now: str, *, most_seconds: int = 900) -> DataFrame:
    """Entries (path, verified_ts) that weren't verified within the last quarter of an hour, the longest first."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("verified_ts")
    return entries.withColumn("age", age).where(F.col("age").isNull() | (F.col("age") > most_seconds)).orderBy(F.col("age").desc_nulls_first(), "path")

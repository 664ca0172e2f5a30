"""History as a source: a log of commits in text segments, read newest first.

A segment is a text file of one stretch of time. Its first line tells how many
commits it has and when the newest and oldest were made; commits follow, newest
first, each with a line for its subject and one for each path:

    segment 2 1000 900
    commit <oid> 1000 <author>
    subject <first line of the message>
    M<tab>path

The data source ``commit_log`` plans one partition a segment. It reads the first
lines to plan, leaves out segments wholly beyond the cut-off or behind
``max_commits`` newer commits, and a task stops at the first commit that is too
old. Both are options: what a filter pushes down stays, in this version of Spark,
with the loaded table, so another scan of the same frame would lose rows too.
Files are opened by pyarrow's file systems, so also in stores that Python's
``open`` can't reach.

:func:`between` and the functions after it name changed paths of versions.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.scratch import cut

SCHEMA = "oid string, unix long, author string, subject string, status string, path string"


@dataclass(frozen=True)
class Segment(InputPartition):
    path: str
    commits: int
    newest: int
    oldest: int


def _store(root: str) -> tuple:
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _files(root: str) -> tuple:
    from pyarrow import fs

    store, at = _store(root)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return store, [f.path for f in found if f.is_file and not f.base_name.startswith(("_", "."))]


def _lines(store, path: str) -> Iterator[str]:
    with store.open_input_stream(path, compression=None) as raw:
        yield from (line.rstrip("\r\n") for line in io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"))


def planned(segments: list[Segment], cutoff: int | None, max_commits: int | None) -> list[Segment]:
    """Newest first: those with a commit at or after the cut-off that fewer than ``max_commits`` are surely newer than."""
    kept = [s for s in segments if cutoff is None or s.newest >= cutoff]
    if max_commits is not None:
        kept = [s for s in kept if sum(o.commits for o in kept if o.oldest > s.newest) < max_commits]
    return sorted(kept, key=lambda s: (-s.newest, s.path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path")
        if not self.root:
            raise ValueError("a commit log needs a path")
        number = lambda key: int(options[key]) if options.get(key) is not None else None
        self.cutoff, self.most = number("cutoff"), number("max_commits")
        if self.most is not None and self.most < 0:
            raise ValueError("max_commits is not negative")

    def partitions(self) -> list[Segment]:
        store, paths = _files(self.root)
        found = []
        for path in paths:
            head = next(_lines(store, path), "").split(" ")
            if head[0] != "segment" or len(head) != 4:
                raise ValueError(f"{path} doesn't begin with a segment's line")
            found.append(Segment(path, *map(int, head[1:])))
        return planned(found, self.cutoff, self.most)

    def read(self, partition: Segment) -> Iterator[tuple]:
        store, _ = _store(self.root)
        commit, subject, seen = None, "", 0
        for line in _lines(store, partition.path):
            word, _, rest = line.partition(" ")
            if word == "commit":
                oid, unix, author = (rest.split(" ", 2) + ["", ""])[:3]
                seen += 1
                if (self.cutoff is not None and int(unix) < self.cutoff) or (self.most is not None and seen > self.most):
                    return
                commit, subject = (oid, int(unix), author), ""
            elif word == "subject" and commit:
                subject = rest
            elif "\t" in line and commit:
                status, path = line.split("\t", 1)
                yield (*commit, subject, status, path)


class CommitLog(DataSource):
    """``spark.read.format("commit_log").option("cutoff", 900).option("max_commits", 500).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitLog)


def scan(spark: SparkSession, root: str, *, cutoff: int | None = None, max_commits: int | None = None) -> DataFrame:
    """The log below a folder: commits at or after ``cutoff`` (Unix seconds), the ``max_commits`` newest that have files among them."""
    register(spark)
    reader = spark.read.format("commit_log")
    if cutoff is not None:
        reader = reader.option("cutoff", cutoff)
    if max_commits is None:
        return reader.load(root)
    return newest(reader.load(root), max_commits)  # a commit without files takes no place, so segments aren't left out by number


def write(commits: DataFrame, files: DataFrame, root: str) -> None:
    """Writes commits (oid, unix, author, subject) and their files (oid, status, path) as a log, a segment for each month.

    Line breaks within a value become spaces. A commit without files stands in
    its segment all the same.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]", " ")
    month = F.date_format(F.timestamp_seconds("unix"), "yyyyMM")
    told = commits.select("oid", "unix", month.alias("segment"), flat("author").alias("author"), flat("subject").alias("subject"))
    heads = told.groupBy("segment").agg(F.count("*").alias("n"), F.max("unix").alias("newest"), F.min("unix").alias("oldest"))
    lines = heads.select("segment", F.lit(0).alias("part"), F.lit(None).cast("long").alias("age"), F.lit("").alias("oid"), F.lit(0).alias("nth"), F.concat_ws(" ", F.lit("segment"), "n", "newest", "oldest").alias("value"))
    own = told.select("segment", F.lit(1).alias("part"), (-F.col("unix")).alias("age"), F.col("oid").cast("string").alias("oid"), F.lit(0).alias("nth"), F.concat(F.lit("commit "), F.col("oid").cast("string"), F.lit(" "), F.col("unix").cast("string"), F.lit(" "), "author", F.lit("\nsubject "), "subject").alias("value"))
    touched = files.join(told.select("oid", "segment", "unix"), "oid").select("segment", F.lit(1).alias("part"), (-F.col("unix")).alias("age"), F.col("oid").cast("string").alias("oid"), F.lit(1).alias("nth"), F.concat(F.col("status"), F.lit("\t"), flat("path")).alias("value"))
    every = lines.unionByName(own).unionByName(touched).repartition("segment").sortWithinPartitions("segment", "part", "age", "oid", "nth", "value")
    every.select("segment", "value").write.mode("overwrite").partitionBy("segment").text(root)


def newest(log: DataFrame, most: int, *, cutoff: int | None = None) -> DataFrame:
    """The rows of the ``most`` newest commits (those of one second by oid), none older than the cut-off."""
    kept = log if cutoff is None else log.where(F.col("unix") >= cutoff)
    heads = kept.select("oid", "unix").distinct().orderBy(F.desc("unix"), "oid").limit(most)
    return kept.join(heads.select("oid"), "oid", "left_semi")


# -- changed paths of versions (path, digest)


def between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified from one version to the other."""
    a, b = old.select("path", F.col("digest").alias("_a"), F.lit(1).alias("_o")), new.select("path", F.col("digest").alias("_b"), F.lit(1).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def uncommitted(head: DataFrame, worktree: DataFrame) -> DataFrame:
    """Changes of tracked paths in a worktree (path, digest, tracked, staged) against a version, staged or not."""
    return between(head, worktree.where("tracked OR staged"))


def untracked(worktree: DataFrame) -> DataFrame:
    """Paths of a worktree that are neither tracked nor staged."""
    return worktree.where("NOT tracked AND NOT staged").select("path", F.lit("untracked").alias("change"))


def changed_paths(base: DataFrame, head: DataFrame, worktree: DataFrame, *, include_untracked: bool = True) -> DataFrame:
    """Distinct (path, change) of base to head, the worktree's changes, and its untracked paths; a path has its first kind of these."""
    parts = [between(base, head).withColumn("_at", F.lit(0)), uncommitted(head, worktree).withColumn("_at", F.lit(1))]
    if include_untracked:
        parts.append(untracked(worktree).withColumn("_at", F.lit(2)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("path").agg(F.min_by("change", "_at").alias("change"))


def within_budget(refs: DataFrame, most_bytes: int, most_files: int) -> tuple[DataFrame, DataFrame]:
    """Entries (ref, path, byte_len) of each ref that fit its budgets, in order of path; and what was left out (ref, n_files, bytes).

    An entry counts if all entries up to it, itself included, fit. Running sums
    come in two steps, within ranges of paths and over the ranges, so that a ref
    with very many paths is not one task.
    """
    # written, so that both uses see the same ranges
    spans = cut(refs.repartitionByRange("ref", "path").withColumn("_p", F.spark_partition_id()), "refs")
    sums = spans.groupBy("ref", "_p").agg(F.count("*").alias("n"), F.sum("byte_len").alias("b"))
    ahead = Window.partitionBy("ref").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each ref and range
    base = sums.select("ref", "_p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("_b0"))
    own = Window.partitionBy("ref", "_p").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = spans.join(base, ["ref", "_p"]).withColumn("_n", F.col("_n0") + F.count("*").over(own)).withColumn("_b", F.col("_b0") + F.sum("byte_len").over(own))
    fits = (F.col("_n") <= most_files) & (F.col("_b") <= most_bytes)
    kept = run.where(fits).select(*refs.columns)
    rest = run.where(~fits).groupBy("ref").agg(F.count("*").alias("n_files"), F.sum("byte_len").alias("bytes"))
    return kept, rest

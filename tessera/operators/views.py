"""Rankings, exports, paging and summaries over results of other operators."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** any parts, * within a part, ? one character, {a,b} either."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.sub(r"([^\w/-])", r"\\\1", c))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in {pattern!r}")
    return f"^{out}$"


def interleave(rows: DataFrame, lane: Column, order: list) -> DataFrame:
    """The lanes' rows in turn: the first of each, then the second of each."""
    nth = F.row_number().over(Window.partitionBy(lane).orderBy(*order)).cast("long")
    return rows.withColumn("turn", nth).withColumn("lane", lane)


def _nearest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(group, old_line, new_line) of rows (group, line, is_new) in order of group and line.

    What is left on the new line's earlier side is a stack; an old line that comes
    later is offered to the new ones that wait for it, first to the earliest. So
    each line is taken up once.
    """
    group, before, waiting = None, [], deque()

    def rest() -> Iterator[tuple]:
        while waiting:
            yield group, before.pop() if before else None, waiting.popleft()
        for x in before:
            yield group, x, None
        before.clear()

    for key, line, is_new in rows:
        if key != group:
            yield from rest()
            group = key
        if is_new:
            waiting.append(line)
            continue
        while waiting and before and waiting[0] - before[-1] <= line - waiting[0]:
            yield group, before.pop(), waiting.popleft()
        if waiting:
            yield group, line, waiting.popleft()
        else:
            before.append(line)
    yield from rest()


def nearest_matches(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old symbols with new ones of the same keys (path, name, kind), one to one: (keys, old_line, new_line), null where one has no match.

    New symbols choose in order of their lines, each the nearest old line that is
    left (the earlier of two as near). A group holds the symbols of one file that
    share name and kind; its lines come sorted, and one pass takes each once.
    """
    side = lambda f, is_new: f.select(*keys, F.col("line").cast("long").alias("_line"), F.lit(is_new).alias("_new")).where("_line IS NOT NULL")
    every = side(old, False).unionByName(side(new, True))
    types = {f.name: f.dataType for f in every.schema}
    out = StructType([*[StructField(k, types[k]) for k in keys], StructField("old_line", LongType()), StructField("new_line", LongType())])
    unknown = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    # a null key equals nothing
    lone = every.where(unknown).select(*keys, F.when(~F.col("_new"), F.col("_line")).alias("old_line"), F.when(F.col("_new"), F.col("_line")).alias("new_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((*k,), line, is_new) for b in batches for *k, line, is_new in zip(*[c.to_pylist() for c in b.columns], strict=True))
        matched = _nearest(rows)
        while some := list(islice(matched, 10_000)):
            columns = [*zip(*[k for k, _, _ in some], strict=True), [o for _, o, _ in some], [n for _, _, n in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow, strict=True)], names=out.names)

    arrow = [to_arrow_type(f.dataType) for f in out]
    # an old line comes before a new one at the same place
    sorted_ = every.where(~unknown).repartition(*keys).sortWithinPartitions(*keys, "_line", "_new")
    return sorted_.mapInArrow(run, out).unionByName(lone)


def prefixes(paths: DataFrame) -> DataFrame:
    """Files and bytes below each directory of (path, byte_len)."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select(F.explode(dirs).alias("dir"), "byte_len").groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("byte_len").alias("bytes"))


def compact(lines: DataFrame, errors: Column, query: Column, *, per_file: int = 10, files: int = 20) -> DataFrame:
    """Lines of a large result that are worth keeping: of the best files all error lines and the best others."""
    scored = lines.withColumn("error", errors).withColumn("points", (F.when(errors, 5).otherwise(0) + F.when(query, 3).otherwise(0)).cast("long")).where("points > 0")
    best = scored.groupBy("path").agg(F.sum("points").alias("total")).orderBy(F.desc("total"), "path").limit(files)
    kept = scored.join(F.broadcast(best.select("path")), "path")  # at most ``files`` rows
    nth = F.row_number().over(Window.partitionBy("path", "error").orderBy(F.desc("points"), "line_no"))
    return kept.withColumn("nth", nth).where(F.col("error") | (F.col("nth") <= per_file)).select("path", "line_no", "points")


def recency_store(blobs: DataFrame, *, entries: int, size: int) -> DataFrame:
    """Of blobs (lane, handle, bytes, at) those a bounded store of each lane keeps: the newest, up to a number and a total of bytes."""
    order = Window.partitionBy("lane").orderBy(F.desc("at"), F.desc("handle"))
    used = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blobs.withColumn("used", used).withColumn("nth", F.row_number().over(order).cast("long")).where((F.col("nth") <= entries) & (F.col("used") <= size))


def page(rows: DataFrame, order: list, *, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def dot(edges: DataFrame, *, limit: int = 200) -> DataFrame:
    """The least ``limit`` edges (src, dst) as one DOT text."""
    some = edges.orderBy("src", "dst").limit(limit)
    line = F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", line.alias("line")))), lambda x: x["line"]), "\n")
    return some.agg(F.concat(F.lit("digraph {\n"), listed, F.lit("\n}")).alias("text"))


def mermaid(edges: DataFrame, *, limit: int = 200) -> DataFrame:
    """The least ``limit`` edges (src, dst) as one Mermaid text."""
    some = edges.orderBy("src", "dst").limit(limit)
    line = F.format_string("  n%s --> n%s", F.col("src").cast("string"), F.col("dst").cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", line.alias("line")))), lambda x: x["line"]), "\n")
    return some.agg(F.concat(F.lit("graph LR\n"), listed).alias("text"))


#: Words of a question and the operator they call for; the first that matches holds.
ROUTES = (
    ("references", r"\b(who calls|callers|references|used by|usages)\b"),
    ("impact", r"\b(impact|break|blast|affected)\b"),
    ("history", r"\b(changed|churn|history|commit|owner)\b"),
    ("symbols", r"\b(function|class|method|symbol|defined)\b"),
    ("files", r"\b(file|path|folder|directory)\b"),
)


def route(question: Column) -> Column:
    out = None
    for name, pattern in ROUTES:
        hit = F.lower(question).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("text")

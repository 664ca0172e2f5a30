"""Reference joins, call graphs, overlays and diffs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ranking import global_row_number
from tessera.scratch import cut


def resolve_unique(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (call, name) with the definition (node) of that name; a name with several definitions resolves nothing."""
    single = definitions.groupBy("name").agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1")
    return calls.join(single.select("name", "node"), "name")


def resolve_qualified(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (call, name, qualified) with the one definition (node, name, path, owner) their qualifier means.

    A single definition of a name needs no qualifier. Of several, those count
    whose file's stem or a folder is the last qualifier (``a::b::f``: b); only if
    there is none, those whose owner type it is. More than one resolves nothing.
    """
    single = resolve_unique(calls, definitions).select("call", "name", "node")
    hint = F.regexp_extract("qualified", r"([^:]+)::[^:]*$", 1)
    alone = definitions.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    asked = calls.join(alone, "name", "left_anti").where("qualified IS NOT NULL").withColumn("hint", hint).where("hint <> ''").select("call", "name", "hint")
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    # every word a definition may be asked by, and whether it is of its path
    words = F.array_distinct(F.concat(F.transform(F.array_append(parts, stem), lambda w: F.struct(w.alias("hint"), F.lit(True).alias("by_path"))), F.array(F.struct(F.col("owner").alias("hint"), F.lit(False).alias("by_path")))))
    named = definitions.select("node", "name", F.explode(words).alias("w")).select("node", "name", "w.hint", "w.by_path").where("hint IS NOT NULL AND hint <> ''")
    # counted before they meet the calls, so a call meets one row however many definitions share its word
    meant = named.groupBy("name", "hint").agg(
        F.count_if("by_path").alias("paths"), F.count_if(~F.col("by_path")).alias("owners"), F.min(F.when(F.col("by_path"), F.col("node"))).alias("p"), F.min(F.when(~F.col("by_path"), F.col("node"))).alias("o")
    )
    found = asked.join(meant, ["name", "hint"]).groupBy("call", "name").agg(F.sum("paths").alias("paths"), F.sum("owners").alias("owners"), F.min("p").alias("p"), F.min("o").alias("o"))
    node = F.when(F.col("paths") == 1, F.col("p")).when((F.col("paths") == 0) & (F.col("owners") == 1), F.col("o"))
    return single.unionByName(found.select("call", "name", node.alias("node")).where("node IS NOT NULL"))


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, order: list[Column]) -> DataFrame:
    """Each point with the first by ``order`` of the ranges (start, end inclusive) that hold it; without one it keeps nulls."""
    from tessera.operators.resolution import range_join

    held = [c for c in ranges.columns if c not in keys]
    # by stretches of lines, so that a file with many points and ranges is spread; points as one value, so nulls keep their match
    inside = range_join(points, ranges, keys, at).withColumn("_p", F.struct(*points.columns))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    best = inside.withColumn("_nth", nth).where("_nth = 1").select("_p", F.struct(*held).alias("_r"))
    asked = points.withColumn("_p", F.struct(*points.columns))
    on = asked["_p"].eqNullSafe(best["_p"])
    return asked.join(best, on, "left").select(*[asked[c] for c in points.columns], *[F.col(f"_r.{c}").alias(c) for c in held])


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) without self-calls."""
    return calls.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes that reach a seed in at most ``depth`` hops, by the fewest; seeds are left out.

    A join and an anti-join a hop, each written to the shared folder so plans
    stay short; the frontier and the visited set stay distributed.
    """
    visited = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long")), "hop")
    frontier = visited
    for hop in range(1, depth + 1):
        nexts = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        frontier = cut(nexts.join(visited, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long")), "hop")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.where("hop > 0")


@dataclass(frozen=True)
class Reached:
    """``nodes`` (node, hop) and whether there were more than asked for."""

    nodes: DataFrame
    truncated: bool


def bounded_reach(edges: DataFrame, seeds: DataFrame, depth: int, most: int) -> Reached:
    """:func:`reach` with at most ``most`` nodes: the nearest, of one hop those with more edges into the hop before, then by node.

    Only the hop that crosses the bound is put in order, by ranges; it ends the
    search, so no hop is longer than what is left.
    """
    visited = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long")), "hop")
    frontier, left, truncated = visited, most, False
    for hop in range(1, depth + 1):
        into = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg((-F.count_distinct("dst")).alias("_order"))
        found = cut(into.join(visited, "node", "left_anti"), "hop")
        n = found.count()
        if not n:
            break
        if n > left:
            truncated = True
            found = global_row_number(found, ["_order", "node"], "_nth").where(F.col("_nth") <= left) if left else found.where("false")
        frontier = cut(found.select("node", F.lit(hop).cast("long").alias("hop")), "hop") if truncated else found.select("node", F.lit(hop).cast("long").alias("hop"))
        visited, left = visited.unionByName(frontier), left - min(n, left)
        if truncated:
            break
    return Reached(visited.where("hop > 0"), truncated)


def risk(hop: Column, entry: Column) -> Column:
    return F.when((hop == 1) & entry, "critical").when(hop == 1, "high").when(hop == 2, "medium").otherwise("low")


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, modified or same, for each key of two versions."""
    o, n = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    both = o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), keys, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("modified")
    return both.select(*keys, "old", "new", change.alias("change"))


def overlay(base: DataFrame, upserts: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """The base without changed keys, and the upserts."""
    changed = upserts.select(key).unionByName(tombstones.select(key)).distinct()
    return base.join(changed, key, "left_anti").unionByName(upserts)


def evict(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges (a, b, ...) whose two ends are live (path)."""
    return edges.join(live.select(F.col("path").alias("a")), "a", "left_semi").join(live.select(F.col("path").alias("b")), "b", "left_semi")


def links(candidates: DataFrame, targets: DataFrame, *, samples: int = 8) -> DataFrame:
    """Link texts (unit, target) as exact, ambiguous or missing, with some of the paths they may mean."""
    named = targets.select(F.col("name").alias("target"), "path")
    # a common name's paths are cut down in buckets before they meet
    bucket = F.pmod(F.xxhash64("path"), F.lit(64))
    least = lambda c: F.slice(F.array_sort(c), 1, samples)
    parts = named.distinct().groupBy("target", bucket.alias("_b")).agg(F.count("*").alias("n"), least(F.collect_list("path")).alias("paths"))
    some = parts.groupBy("target").agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("paths"))).alias("paths"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return candidates.join(some, "target", "left").select("unit", "target", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.array_join(F.coalesce("paths", F.array().cast("array<string>")), ",").alias("paths"))


def without_definitions(references: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """References that don't stand where a definition does."""
    return references.join(definitions.select(*keys), keys, "left_anti")

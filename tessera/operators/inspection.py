"""Looking at one place, grouped search, lookups by part of a path, gram upkeep and edit previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.resolution import range_join
from tessera.operators.search import trigrams


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each line (path, line_no, ...) with the deepest of the symbols (path, name, depth, start, end) around it; of equals the later start, then the name. Lines outside keep nulls."""
    inside = range_join(lines.select("path", "line_no").distinct(), symbols.select("path", "name", "depth", "start", "end"), ["path"], "line_no")
    best = inside.groupBy("path", "line_no").agg(F.max_by("name", F.struct("depth", "start", "name")).alias("symbol"), F.max("depth").alias("symbol_depth"))
    return lines.join(best, ["path", "line_no"], "left")


def grouped_hits(hits: DataFrame, symbols: DataFrame, by: str, *, noise: Column | None = None) -> DataFrame:
    """Hits (path, line_no, line) by file, by symbol around them, as usages (noise left out) or as distinct symbol names."""
    if by == "file":
        return hits.groupBy("path").agg(F.count("*").alias("hits"))
    if by == "usage":
        return hits.where(~noise) if noise is not None else hits
    around = enclosing(hits, symbols).where("symbol IS NOT NULL")
    if by == "symbol":
        return around.groupBy("path", "symbol").agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"))
    if by == "names":
        return around.select("symbol").distinct()
    raise ValueError(f"group by file, symbol, usage or names, not {by!r}")


def follow(groups: DataFrame, references: DataFrame, *, files: int = 3, callers: int = 5) -> DataFrame:
    """Of :func:`grouped_hits` by symbol the ``files`` first by hits, each with up to ``callers`` places (path) that refer to it."""
    best = groups.groupBy("path").agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), "path").limit(files)
    some = groups.join(F.broadcast(best.select("path")), "path")  # at most ``files`` rows
    refs = references.select(F.col("name").alias("symbol"), F.col("path").alias("caller")).distinct()
    nth = F.row_number().over(Window.partitionBy("path", "symbol").orderBy(F.col("caller").asc_nulls_last()))
    kept = some.join(refs, "symbol", "left").withColumn("_nth", nth).where(F.col("_nth") <= callers)
    return kept.groupBy("path", "symbol").agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("callers"))


def inspect(points: DataFrame, symbols: DataFrame, *, siblings: int = 10) -> DataFrame:
    """Each point (path, line_no) with its parents (the tightest symbol of each depth) and, beside the deepest, siblings of its depth.

    Gives (path, line_no, parents, siblings, overflow): names joined by ``>`` and
    commas, and how many siblings the limit leaves out.
    """
    at = points.select("path", "line_no").distinct()
    inside = range_join(at, symbols.select("path", "name", "depth", "start", "end"), ["path"], "line_no")
    tight = inside.groupBy("path", "line_no", "depth").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "start", "name")).alias("s"))
    chain = tight.groupBy("path", "line_no").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("s.name").alias("name"), F.col("s.start").alias("start")))).alias("c"))
    own = chain.select("path", "line_no", F.array_join(F.transform("c", lambda x: x["name"]), " > ").alias("parents"), F.element_at("c", -1).alias("own"))
    # the first siblings and one more are enough, as the symbol itself may be among them
    nth = F.row_number().over(Window.partitionBy("path", "depth").orderBy("start", "name"))
    first = symbols.select("path", "depth", "start", "name").withColumn("_nth", nth).where(F.col("_nth") <= siblings + 1)
    level = first.groupBy("path", "depth").agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("level"))
    sizes = symbols.groupBy("path", "depth").agg(F.count("*").alias("n"))
    joined = own.withColumn("depth", F.col("own.depth")).join(level, ["path", "depth"]).join(sizes, ["path", "depth"])
    mine = F.struct(F.col("own.start").alias("start"), F.col("own.name").alias("name"))
    others = F.filter("level", lambda x: (x["start"] != mine["start"]) | (x["name"] != mine["name"]))
    shown = F.array_join(F.transform(F.slice(others, 1, siblings), lambda x: x["name"]), ",")
    out = joined.select("path", "line_no", "parents", shown.alias("siblings"), F.greatest(F.col("n") - 1 - siblings, F.lit(0)).cast("long").alias("overflow"))
    return at.join(out, ["path", "line_no"], "left")


def by_basename(files: DataFrame, names: list[str]) -> DataFrame:
    return files.select("path").where(F.lower(F.element_at(F.split("path", "/"), -1)).isin([n.lower() for n in names]))


def by_component(files: DataFrame, component: str) -> DataFrame:
    """Paths with a folder of that name."""
    parts = F.split(F.lower("path"), "/")
    return files.select("path").where(F.array_contains(F.slice(parts, 1, F.size(parts) - 1), component.lower()))


def manifest_paths(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Files that manifests (path, content: JSON) name as entry points, relative to their folder: (manifest, path)."""
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    named = F.array_compact(F.array(*[F.get_json_object("content", f"$.{k}") for k in ("main", "module", "types", "bin")]))
    asked = manifests.select(F.col("path").alias("manifest"), folder.alias("_d"), F.explode(named).alias("_n"))
    asked = asked.select("manifest", F.concat("_d", F.regexp_replace("_n", r"^\./", "")).alias("path")).distinct()
    return asked.join(files.select("path"), "path", "left_semi").select("manifest", "path")


def update_grams(grams: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The gram table (gram, id) after units (id, text) changed or came and others (id) went; equals building it anew."""
    gone = changed.select("id").unionByName(removed.select("id")).distinct()
    fresh = changed.select(F.explode(trigrams(F.col("text"))).alias("gram"), "id")
    return grams.select("gram", "id").join(gone, "id", "left_anti").select("gram", "id").unionByName(fresh)


def rename_preview(lines: DataFrame, old: str, new: str) -> DataFrame:
    """Lines (path, line_no, line) with the whole word ``old``: the line after a rename, how many sites, how many of them certain (outside strings and comments)."""
    if not old or not new or old == new:
        raise ValueError("a rename takes two different names")
    word = F.lit(rf"(?<![0-9A-Za-z_])\Q{old}\E(?![0-9A-Za-z_])")
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    code = F.regexp_replace(F.regexp_replace("line", r'"(\\.|[^"\\])*"', '""'), "//.*$|(^|\\s)#.*$", "")
    found = lines.withColumn("sites", F.regexp_count("line", word).cast("long")).where("sites > 0")
    return found.withColumn("certain", F.regexp_count(code, word).cast("long")).withColumn("after", F.regexp_replace(F.col("line"), word, F.lit(safe)))


def edit_plan(edits: DataFrame) -> DataFrame:
    """Edits (path, start, end exclusive, text) with whether each can be applied: repeats once, empty or crossing ranges refused.

    Of two that overlap neither is applied; the order is from the end of the file, so earlier offsets stay good.
    """
    once = edits.select("path", "start", "end", "text").distinct()
    good = (F.col("start") >= 0) & (F.col("end") >= F.col("start"))
    order = Window.partitionBy("path", good).orderBy("start", "end", "text")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the rows behind, in the order backwards: a frame that grows takes each row once, one that shrinks begins anew at each
    back = Window.partitionBy("path", good).orderBy(F.desc("start"), F.desc("end"), F.desc("text"))
    after = F.min("start").over(back.rowsBetween(Window.unboundedPreceding, -1))
    crossing = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    state = F.when(~good, "invalid").when(crossing, "overlap").otherwise("applicable")
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("start"), F.desc("end"), F.desc("text"))).cast("long")
    return once.withColumn("state", state).withColumn("nth", place)


def _ancestors(parents: DataFrame, starts: DataFrame, stride: int) -> DataFrame:
    """(node, side): the starts (node, side) and every commit reachable from them over (child, parent).

    Links are first widened to all commits within ``stride`` steps (by doubling),
    so a history takes its depth over the stride in rounds. Visited commits stay
    a distributed table, written each round.
    """
    from tessera.scratch import cut

    links = parents.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    reach_ = 1
    while reach_ < stride:
        further = links.alias("x").join(links.alias("y"), F.col("x.parent") == F.col("y.child")).select("x.child", "y.parent")
        links, reach_ = cut(links.unionByName(further).distinct(), "links"), 2 * reach_
    seen = frontier = cut(starts.distinct(), "seen")
    while True:
        nexts = links.join(frontier, F.col("child") == F.col("node")).select(F.col("parent").alias("node"), "side").distinct()
        frontier = cut(nexts.join(seen, ["node", "side"], "left_anti"), "seen")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def ahead_behind(parents: DataFrame, local: str, upstream: str, *, stride: int = 16) -> tuple[int, int] | None:
    """How many commits only ``local`` reaches, and only ``upstream``; None if they share none."""
    starts = parents.sparkSession.createDataFrame([(local, "l"), (upstream, "u")], "node string, side string")
    sides = _ancestors(parents, starts, stride).groupBy("node").agg(F.max(F.col("side") == "l").alias("l"), F.max(F.col("side") == "u").alias("u"))
    n = sides.agg(F.count_if(F.col("l") & ~F.col("u")).alias("ahead"), F.count_if(F.col("u") & ~F.col("l")).alias("behind"), F.count_if(F.col("l") & F.col("u")).alias("both")).first()
    return (n.ahead, n.behind) if n.both else None


def commit_distance(parents: DataFrame, start: str, end: str, *, stride: int = 16) -> int | None:
    """Commits that ``end`` reaches and ``start`` doesn't; None for unrelated histories."""
    found = ahead_behind(parents, end, start, stride=stride)
    return None if found is None else found[0]

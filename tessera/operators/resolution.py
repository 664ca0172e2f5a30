"""Imports, dependents, references, selectors and edit impact as joins.

Joins are by equal keys throughout: module paths, stems and aliases are opened
into candidate keys, ranges into stretches of lines, so a file or name that holds
many rows is spread over tasks (AQE splits what is left).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.views import glob_regex


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, *, width: int = 256) -> DataFrame:
    """Points with each of the ranges (keys, start, end inclusive) that holds them.

    Ranges are opened into stretches of ``width`` places and joined by key and
    stretch. A point lies in one stretch, so no pair comes twice.
    """
    opened = ranges.where("end >= start").withColumn("_s", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    joined = points.withColumn("_s", F.floor(F.col(at) / width)).join(opened, [*keys, "_s"])
    return joined.where(F.col(at).between(F.col("start"), F.col("end"))).drop("_s")


def outside(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, *, width: int = 256) -> DataFrame:
    """Points that none of the ranges holds: text outside inline test modules, say."""
    p = points.withColumn("_s", F.floor(F.col(at) / width))
    opened = ranges.where("end >= start").select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_s"))
    r = opened.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_rs"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)), F.col("_s") == F.col("_rs"))
    return p.join(r, on & F.col(at).between(F.col("_from"), F.col("_to")), "left_anti").drop("_s")


def module_path(path: Column) -> Column:
    """A file's path as a dotted module: no extension, no closing ``__init__``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/__init__$", ""), "/", ".")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def _absolute(importer: Column, name: Column) -> Column:
    """A relative import (leading dots) as a dotted module below the importer's folder; null where the dots leave the root."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    folders = F.split(importer, "/")
    left = F.size(folders) - dots
    head = F.array_join(F.slice(folders, 1, F.greatest(left, F.lit(0))), ".")
    tail = F.regexp_replace(name, r"^\.+", "")
    return F.when(left >= 0, F.concat_ws(".", F.when(head != "", head), F.when(tail != "", tail)))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (importer, target) from imports (importer, language, name) and files (path, language).

    A relative import means one module path and nothing else. Any other name means
    files of the same language whose module path it is, or whose stem is its last part.
    A file doesn't import itself.
    """
    relative = F.col("name").startswith(".")
    dotted = F.regexp_replace("name", "::|/", ".")
    wanted = F.when(relative, F.array(F.concat(F.lit("m:"), _absolute(F.col("importer"), F.col("name"))))).otherwise(F.array(F.concat(F.lit("m:"), dotted), F.concat(F.lit("s:"), F.element_at(F.split(dotted, r"\."), -1))))
    asked = imports.select("importer", "language", F.explode(wanted).alias("key")).where("key IS NOT NULL").distinct()
    offered = files.select(F.col("path").alias("target"), "language", F.explode(F.array(F.concat(F.lit("m:"), module_path(F.col("path"))), F.concat(F.lit("s:"), stem(F.col("path"))))).alias("key"))
    return asked.join(offered, ["language", "key"]).where("importer <> target").select("importer", "target").distinct()


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first of ``tiers`` that has any for a key, with the tier's number from 0."""
    every = reduce(DataFrame.unionByName, (t.withColumn("tier", F.lit(i).cast("long")) for i, t in enumerate(tiers)))
    best = every.groupBy(key).agg(F.min("tier").alias("tier"))
    return every.join(best, [key, "tier"])


def through_reexports(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(importer, target, hops): importers of a target, directly or by one or two re-exports (hub, target), by the fewest hops."""
    direct = imports.select("importer", "target", F.lit(0).cast("long").alias("hops"))
    one = reexports.select("hub", "target").distinct()
    two = one.alias("x").join(one.alias("y"), F.col("x.target") == F.col("y.hub")).select(F.col("x.hub").alias("hub"), F.col("y.target").alias("target")).distinct()
    by = lambda hubs, n: imports.select("importer", F.col("target").alias("hub")).join(hubs, "hub").select("importer", "target", F.lit(n).cast("long").alias("hops"))
    every = direct.unionByName(by(one, 1)).unionByName(by(two, 2)).where("importer <> target")
    # few rows repeat within a task, so they are dealt out before any are held
    return every.repartition("importer", "target").groupBy("importer", "target").agg(F.min("hops").alias("hops"))


def named_references(references: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """References (path, start, name, qualifier) to a name: by itself, by an alias of the same file, or as the qualifier; each place once (the least row)."""
    by_name = references.where((F.col("name") == name) | (F.col("qualifier") == name))
    own = aliases.where(F.col("original") == name).select("path", F.col("alias").alias("name")).distinct()
    every = by_name.select("path", "start", "name", "qualifier").unionByName(references.join(own, ["path", "name"]).select("path", "start", "name", "qualifier"))
    return every.groupBy("path", "start").agg(F.min(F.struct("name", "qualifier")).alias("r")).select("path", "start", "r.name", "r.qualifier")


def exact_references(references: DataFrame, owner: str, name: str) -> DataFrame:
    """References (qualified, caller) that mean ``owner::name`` by their closing parts, but those from the symbol itself."""
    whole = f"{owner}::{name}"
    means = (F.col("qualified") == whole) | F.col("qualified").endswith(f"::{whole}")
    return references.where(means & ~F.col("caller").eqNullSafe(F.lit(whole)))


def implementations(rows: DataFrame, name: str, direction: str = "auto") -> DataFrame:
    """Rows (trait, type) whose trait, type or (auto) either is the name."""
    sides = {"trait": F.col("trait") == name, "type": F.col("type") == name}
    if direction not in (*sides, "auto"):
        raise ValueError(f"direction is trait, type or auto, not {direction!r}")
    return rows.where(sides.get(direction, sides["trait"] | sides["type"]))


def type_dependencies(uses: DataFrame, definitions: DataFrame, seeds: list[str], *, depth: int = 2, limit: int = 15) -> DataFrame:
    """Types (name, depth) that defined seeds use, over uses (name, used), by the fewest steps; the nearest ``limit``.

    A type without a definition (name, path) ends its branch.
    """
    known = definitions.groupBy("name").agg(F.min("path").alias("path"))
    level = known.where(F.col("name").isin(seeds)).select("name", F.lit(0).cast("long").alias("depth"))
    found = level
    for d in range(1, depth + 1):
        nexts = uses.join(level.select("name"), "name", "left_semi").select(F.col("used").alias("name")).distinct()
        level = nexts.join(known.select("name"), "name", "left_semi").withColumn("depth", F.lit(d).cast("long"))
        found = found.unionByName(level)
    nearest = found.groupBy("name").agg(F.min("depth").alias("depth"))
    return nearest.join(known, "name").orderBy("depth", "name").limit(limit)


def owned(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Files (path) with the number of ownership globs that match and the owner of the last one; the rules are a configuration."""
    if not rules:
        return files.select("path", F.lit(0).cast("long").alias("rules"), F.lit(None).cast("string").alias("owner"))
    hits = [F.col("path").rlike(glob_regex(g)) for g, _ in rules]
    owner = F.coalesce(*[F.when(h, F.lit(o)) for h, (_, o) in reversed(list(zip(hits, rules, strict=True)))])
    return files.select("path", sum((h.cast("long") for h in hits), F.lit(0).cast("long")).alias("rules"), owner.alias("owner"))


def membership(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """Paths with whether they are tracked."""
    return paths.join(tracked.select("path").distinct().withColumn("_t", F.lit(True)), "path", "left").withColumn("tracked", F.coalesce("_t", F.lit(False))).drop("_t")


def demoted(files: DataFrame, tracked: DataFrame, folders: list[str]) -> DataFrame:
    """Untracked files below an output folder, unless a tracked file lies below the same one."""
    pattern = "^((?:.*/)?(?:" + "|".join(sorted(folders)) + "))/"
    inside = lambda f: f.withColumn("_p", F.regexp_extract("path", pattern, 1)).where("_p <> ''")
    return inside(files).join(inside(tracked.select("path")).select("_p").distinct(), "_p", "left_anti").drop("_p")


def unseen_callees(calls: DataFrame, definitions: DataFrame, fetched: DataFrame, *, limit: int = 10) -> DataFrame:
    """What fetched symbols call, is defined and wasn't fetched: (name, callers), the most called first."""
    called = calls.join(fetched.select(F.col("name").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("name")).agg(F.count_distinct("src").alias("callers"))
    return called.join(definitions.select("name"), "name", "left_semi").join(fetched.select("name"), "name", "left_anti").orderBy(F.desc("callers"), "name").limit(limit)


def gated(symbol_edges: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Symbol edges (anchor_path, partner_path, ...) whose files are linked too."""
    return symbol_edges.join(file_edges.select(F.col("anchor").alias("anchor_path"), F.col("partner").alias("partner_path")), ["anchor_path", "partner_path"], "left_semi")


def callee_frequency(calls: DataFrame, *, limit: int = 30) -> DataFrame:
    """Calls (name, line) counted by name, with the first line; the most called first."""
    return calls.groupBy("name").agg(F.count("*").alias("n"), F.min("line").alias("first_line")).orderBy(F.desc("n"), "name").limit(limit)


def section_counts(rows: DataFrame, *, cap: int = 20) -> DataFrame:
    """Per section of (section, name): rows, different names and how many names a list of ``cap`` leaves out."""
    out = rows.groupBy("section").agg(F.count("*").alias("total"), F.count_distinct("name").alias("names"))
    return out.withColumn("overflow", F.greatest(F.col("names") - cap, F.lit(0).cast("long")))


#: Kinds by the tier in which a name alone selects them.
KIND_TIERS = {"class": 1, "struct": 1, "enum": 1, "interface": 1, "trait": 1, "module": 2, "function": 3, "method": 3, "impl": 3}


def select_symbol(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (request, path, wanted, wanted_kind) as selected, ambiguous or not_found, with candidate lines.

    The first level with a symbol (path, name, kind, line) counts: 0 the name
    itself, 1 but for white space, 2 after ``impl``, 3 the last part of a qualified
    request, 4 a style selector's start, 5 the type a Swift extension extends.
    Without a kind, a single candidate in the first kind tier is selected. Both
    sides are spelled out by level, and the join is by path, level and spelling.
    """
    level = lambda n, c: F.struct(F.lit(n).alias("level"), c.alias("spelled"))
    squeeze = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    name, wanted = F.col("name"), F.col("wanted")
    offered = F.array(level(0, name), level(1, squeeze(name)), level(2, F.regexp_extract(squeeze(name), "^impl (.*)$", 1)), level(3, name), level(4, F.regexp_extract(name, r"^([@.#][^\s,:({\[]*)", 1)), level(5, name))
    last = F.element_at(F.split(wanted, r"::|\."), -1)
    asked_as = F.array(level(0, wanted), level(1, F.when(squeeze(wanted) != wanted, squeeze(wanted))), level(2, squeeze(wanted)), level(3, F.when(last != wanted, last)), level(4, F.when(wanted.rlike("^[@.#]"), wanted)), level(5, F.regexp_extract(squeeze(wanted), r"^extension (\w+)", 1)))
    spelled = symbols.select("path", "kind", "line", F.inline(offered)).where("spelled <> ''")
    # counted before requests meet them: a request meets a row for each kind, however many symbols share its spelling
    have = spelled.groupBy("path", "level", "spelled", "kind").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    ask = requests.select("request", "path", "wanted_kind", F.inline(asked_as)).where("spelled <> ''")
    hits = ask.join(have, ["path", "level", "spelled"]).where(F.col("wanted_kind").isNull() | (F.col("wanted_kind") == F.col("kind")))
    tier = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in KIND_TIERS.items()], F.lit(4))
    by_tier = hits.withColumn("tier", tier).groupBy("request", "level", "tier").agg(F.sum("n").alias("n"), F.min("line").alias("line"), F.max(F.col("wanted_kind").isNull()).alias("free"))
    levels = by_tier.groupBy("request", "level").agg(F.sum("n").alias("candidates"), F.min(F.struct("tier", "n", "line")).alias("top"), F.max("free").alias("free"))
    first = levels.groupBy("request").agg(F.min(F.struct("level", "candidates", "top", "free")).alias("b"))
    sole = (F.col("b.candidates") == 1) | (F.col("b.free") & (F.col("b.top.n") == 1))
    state = F.when(F.col("b").isNull(), "not_found").when(sole, "selected").otherwise("ambiguous")
    return requests.select("request").join(first, "request", "left").select("request", state.alias("state"), F.coalesce("b.candidates", F.lit(0)).cast("long").alias("candidates"), F.when(state == "selected", F.col("b.top.line")).alias("line"))


def edit_impact(old: DataFrame, new: DataFrame, callers: DataFrame, *, most: int = 5) -> DataFrame:
    """Symbols (path, name, body) added, removed or with other bodies, each with up to ``most`` callers (name, path) of other files."""
    o, n = old.select("path", "name", F.col("body").alias("_o"), F.lit(1).alias("_a")), new.select("path", "name", F.col("body").alias("_n"), F.lit(1).alias("_b"))
    both = o.join(n, ["path", "name"], "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    changed = both.select("path", "name", change.alias("change")).where("change IS NOT NULL")
    ext = callers.select("name", F.col("path").alias("caller_path")).distinct()
    nth = F.row_number().over(Window.partitionBy("path", "name").orderBy(F.col("caller_path").asc_nulls_last()))
    joined = changed.join(ext, "name", "left").withColumn("caller_path", F.when(F.col("caller_path") != F.col("path"), F.col("caller_path")))
    some = joined.withColumn("_nth", nth).where(F.col("_nth") <= most)
    return some.groupBy("path", "name", "change").agg(F.array_join(F.array_sort(F.collect_list("caller_path")), ",").alias("callers"))


def hunk_symbols(hunks: DataFrame, symbols: DataFrame, *, width: int = 256) -> DataFrame:
    """Distinct (oid, path, name): symbols (path, name, first, last) that a commit's hunks (oid, path, first, last) touch.

    Both are opened into stretches of lines and joined by path and stretch.
    """
    stretch = lambda f: f.withColumn("_s", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    h = stretch(hunks.where("first <= last")).select("oid", "path", "_s", F.col("first").alias("_hf"), F.col("last").alias("_hl"))
    s = stretch(symbols.where("first <= last")).select("path", "name", "_s", F.col("first").alias("_sf"), F.col("last").alias("_sl"))
    return h.join(s, ["path", "_s"]).where("_hf <= _sl AND _sf <= _hl").select("oid", "path", "name").distinct()


def header_language(markers: Column, c_errors: Column, cpp_errors: Column, objective: Column) -> Column:
    """The language of a header file: Objective-C is left as C; C++ by markers, or with strictly fewer errors."""
    return F.when(objective, "c").when(markers, "cpp").when(cpp_errors < c_errors, "cpp").otherwise("c")

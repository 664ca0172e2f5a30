"""Everything about a symbol at once, for any number of symbols asked for.

Requests (request, path, name, kind, line; kind and line may be null) meet the
facts of ``sourcecode``. What one asks for is found, ambiguous (with the candidates'
lines) or missing, with the reason. For what is found there are sections:

* ``body``: the symbol's own text.
* ``callers``, ``usages``: calls and type uses of its name, wherever they stand.
* ``callees``, ``types``: what its own text calls and what types it names.
* ``implementations``: what implements it, and what it implements.
* ``siblings``: other names of its file at its depth.
* ``dependents``: files that import its file, by its stem.
* ``suggestions``: of a type that nobody calls, what implements it.
* ``activity``: commits of its file, if a history is given.

A list shows 20 entries by path and line; totals count all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import sourcecode as S
from tessera.scratch import cut

CAP = 20
SECTIONS = ("body", "callers", "usages", "callees", "types", "implementations", "siblings", "dependents", "suggestions", "activity")
_TYPES = ("struct", "enum", "class", "interface", "trait")


def _candidates(requests: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Requests with the symbols (s) that they fit."""
    symbols = S.symbols(facts).select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("kind").alias("_k"), F.struct("ordinal", "first_line", "last_line", "depth", "start", "stop", "kind").alias("s"))
    fits = (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_n")) & (F.col("kind").isNull() | (F.col("kind") == F.col("_k"))) & (F.col("line").isNull() | (F.col("line") == F.col("s.first_line")))
    return requests.join(symbols, fits, how)


def selected(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Requests with state (found, ambiguous, symbol_not_found, file_not_found), candidate lines, and the symbol if it is one."""
    files = S.status(facts).select(F.col("path").alias("_f"), F.lit(True).alias("known")).distinct()
    met = _candidates(requests, facts, "left").groupBy("request", "path", "name").agg(F.count("s").alias("n"), F.min("s").alias("s"), F.array_sort(F.collect_list("s.first_line")).alias("lines"))
    state = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").when(F.col("known"), "symbol_not_found").otherwise("file_not_found")
    return met.join(files, F.col("path") == F.col("_f"), "left").select("request", "path", "name", state.alias("state"), F.when(F.col("n") > 1, F.col("lines")).alias("lines"), F.when(F.col("n") == 1, F.col("s")).alias("symbol"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def entries(requests: DataFrame, facts: DataFrame, files: DataFrame, *, sections: Iterable[str] | None = None, history: DataFrame | None = None) -> DataFrame:
    """All entries (request, section, name, kind, path, line, detail) of what is found; ``history`` is (path, commits, last_ts)."""
    wanted = tuple(SECTIONS if sections is None else sections)
    if unknown := set(wanted) - set(SECTIONS):
        raise ValueError(f"unknown sections {sorted(unknown)}")
    single = _candidates(requests, facts, "inner").groupBy("request", "path", "name").agg(F.count("s").alias("n"), F.min("s").alias("s")).where("n = 1")
    own = single.select("request", F.col("path").alias("own_path"), F.col("name").alias("own_name"), "s.*").withColumnRenamed("kind", "own_kind").withColumnRenamed("ordinal", "own_ordinal").withColumnRenamed("depth", "own_depth").withColumnRenamed("first_line", "own_line")
    if len(wanted) > 1:  # chosen once, not for each section
        own = cut(own, "own-symbols")
    refs = S.references(facts)
    placed = refs.withColumn("where_", F.when(F.col("around").isNotNull(), F.concat_ws(" ", F.lit("in"), "around_kind", "around")))
    row = lambda f, section, name, kind, path, line, detail: f.select("request", F.lit(section).alias("section"), name.alias("name"), kind.alias("kind"), path.alias("path"), line.cast("int").alias("line"), detail.cast("string").alias("detail"))
    c, none = F.col, F.lit(None)
    use = lambda f, section: row(f, section, c("qualified"), c("kind"), c("path"), c("line"), c("where_"))
    named = lambda kind: own.join(placed.where(c("kind") == kind), c("own_name") == c("name"))
    inside = lambda kind: own.join(placed.where(c("kind") == kind), (c("own_path") == c("path")) & (c("own_ordinal") == c("enclosing")))
    parts: dict[str, DataFrame] = {}
    if "body" in wanted:
        text = files.select(c("path").alias("_p"), "content")
        parts["body"] = row(own.join(text, c("own_path") == c("_p")), "body", c("own_name"), c("own_kind"), c("own_path"), c("own_line"), F.expr("substring(content, start + 1, stop - start)"))
    if "callers" in wanted:
        parts["callers"] = use(named("call"), "callers")
    if "usages" in wanted:
        parts["usages"] = use(named("type"), "usages")
    if "callees" in wanted:
        parts["callees"] = use(inside("call"), "callees")
    if "types" in wanted:
        parts["types"] = use(inside("type"), "types")
    makers = own.join(placed.where("kind = 'implements'"), c("own_name") == c("name"))
    if "implementations" in wanted:
        made = own.join(placed.where("kind = 'implements'"), c("own_name") == c("target"))
        parts["implementations"] = row(makers, "implementations", c("target"), F.lit("implements it"), c("path"), c("line"), none).unionByName(row(made, "implementations", c("name"), F.lit("is implemented"), c("path"), c("line"), none))
    if "siblings" in wanted:
        others = S.symbols(facts).select("path", "name", "kind", "depth", "first_line", "last_line")
        parts["siblings"] = row(own.join(others, (c("own_path") == c("path")) & (c("own_depth") == c("depth")) & (c("own_name") != c("name"))), "siblings", c("name"), c("kind"), c("path"), c("first_line"), none)
    if "dependents" in wanted:
        whole = refs.where("kind = 'import'").select("path", "line", "name", F.explode(F.array_distinct(F.split("name", r"::|[./\\]"))).alias("stem"))
        files_ = own.withColumn("stem", _stem(c("own_path"))).join(whole, "stem").where("path <> own_path").groupBy("request", "path").agg(F.min(F.struct("line", "name")).alias("i"))
        parts["dependents"] = row(files_, "dependents", c("i.name"), F.lit("import"), c("path"), c("i.line"), none)
    if "suggestions" in wanted:
        called = own.join(refs.where("kind = 'call'").select(c("name").alias("own_name")).distinct(), "own_name", "left_semi").select("request")
        alone = makers.where(c("own_kind").isin(*_TYPES)).join(called, "request", "left_anti")
        parts["suggestions"] = row(alone, "suggestions", c("target"), F.lit("implements it"), c("path"), c("line"), none)
    if "activity" in wanted and history is not None:
        seen = history.select(c("path").alias("_p"), "commits", "last_ts")
        parts["activity"] = row(own.join(seen, c("own_path") == c("_p")), "activity", c("own_name"), none.cast("string"), c("own_path"), none.cast("int"), F.concat_ws(" ", c("commits").cast("string"), F.lit("commits, last"), c("last_ts").cast("string")))
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    return out if out is not None else row(own.where("false"), "", c("own_name"), c("own_kind"), c("own_path"), c("own_line"), none)


def shown(every: DataFrame, *, cap: int = CAP) -> DataFrame:
    """The first entries of each request and section, numbered."""
    nth = F.row_number().over(Window.partitionBy("request", "section").orderBy("path", F.col("line").asc_nulls_last(), "name", F.col("detail").asc_nulls_last()))
    return every.withColumn("nth", nth).where(F.col("nth") <= cap).withColumn("nth", F.col("nth").cast("long"))


def totals(every: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(request, section, total, names, overflow): entries, different names, and entries that a list doesn't show."""
    last = F.regexp_extract("name", r"([^.:>\\]+)$", 1)
    n = every.groupBy("request", "section").agg(F.count("*").alias("total"), F.count_distinct(last).alias("names"))
    return n.withColumn("overflow", F.greatest(F.col("total") - cap, F.lit(0).cast("long")))

"""Counts that reports show, selections they are made of, and merges of kept tables.

Lists are bounded, their totals are not; ties go by value. Each function takes
plain columns, named in its docstring, and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.search import InvalidQuery

#: Types shown, paths shown, kinds of events that commit to a file, order of buckets of partly read files.
TYPES, PATHS = 15, 200
COMMITMENTS = ("read", "edit")
BUCKETS = ("vendor", "generated", "test_fixture", "template_dsl", "unexpected")


def _stack(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_types(types: DataFrame, references: DataFrame, churn: DataFrame, *, top: int = TYPES) -> DataFrame:
    """The types (path, name, kind) most files depend on: dependents, churn of the type's file, and a label from two on.

    ``references`` is (path, name), ``churn`` (path, churn). A file doesn't depend on its own types.
    """
    uses = references.select(F.col("path").alias("user"), "name").distinct()
    met = types.join(uses, "name", "left").groupBy("path", "name", "kind").agg(F.count_if(F.col("user") != F.col("path")).alias("dependents"))
    scored = met.join(churn.groupBy("path").agg(F.max("churn").alias("churn")), "path", "left").na.fill(0, ["churn"])
    label = F.when(F.col("dependents") >= 2, F.concat(F.lit("→"), F.col("dependents").cast("string")))
    return scored.orderBy(F.desc("dependents"), F.desc("churn"), "path", "name", "kind").limit(top).withColumn("label", label)


def partial_bucket() -> Column:
    """Why a file may be read only in part: the first of BUCKETS by flags vendor, generated, test and template."""
    return F.when(F.col("vendor"), "vendor").when(F.col("generated"), "generated").when(F.col("test"), "test_fixture").when(F.col("template"), "template_dsl").otherwise("unexpected")


def health(files: DataFrame) -> DataFrame:
    """(fact, value, n) of files (path, status, n_symbols, tier, vendor, generated, test, template): counts by status, tier and bucket, and all symbols."""
    bucket = F.when(F.col("status") == "partial", partial_bucket())
    facts = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(f).alias("fact"), c.alias("value"), n.cast("long").alias("n"))) for f, c, n in (("status", F.col("status"), F.lit(1)), ("tier", F.col("tier"), F.lit(1)), ("partial", bucket, F.lit(1)), ("symbols", F.lit("total"), F.coalesce("n_symbols", F.lit(0))))]))
    return files.select(F.explode(facts).alias("f")).groupBy("f.fact", "f.value").agg(F.sum("f.n").alias("n"))


def telemetry(calls: DataFrame, *, top: int = 10) -> DataFrame:
    """(fact, value, n) of calls (id, tool, outcome, success): totals, the last id, and the most frequent tools and outcomes."""
    totals = calls.agg(F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failure"), F.max("id").alias("last_id"))
    wide = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.lit(None).cast("string").alias("value"), F.col(c).cast("long").alias("n")) for c in ("total", "success", "failure", "last_id")])).alias("f")).select("f.*")
    often = lambda c: calls.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_first()).limit(top).select(F.lit(c).alias("fact"), "value", "n")
    return _stack([wide, often("tool"), often("outcome")])


def ledger(events: DataFrame) -> DataFrame:
    """One row of events (net, accepted, session): events, their net (0 of none), accepted ones, and sessions."""
    return events.agg(F.count("*").alias("events"), F.coalesce(F.sum("net"), F.lit(0)).alias("net"), F.count_if("accepted").alias("accepted"), F.count_distinct("session").alias("sessions"))


def import_roots(imports: DataFrame, manifests: DataFrame, *, top: int = 10) -> DataFrame:
    """(root, n): first parts of imported names (name), and what manifests (path, key) depend on, which counts 1 if nothing imports it.

    Names go in lower case; parts of one character don't count. Keys are dotted
    as in ``dependencies.name``; those that go deeper are settings, not names.
    """
    root = F.lower(F.element_at(F.split("name", "::"), 1))
    used = imports.select(root.alias("root")).where(F.octet_length("root") > 1).groupBy("root").agg(F.count("*").alias("n"))
    cargo, package = F.col("path").endswith("Cargo.toml"), F.col("path").endswith("package.json")
    bare = F.when(cargo, F.regexp_extract("key", r"^(?:dependencies|dev-dependencies)\.([^.]+)$", 1)).when(package, F.regexp_extract("key", r"^(?:dependencies|devDependencies)\.([^.]+)$", 1))
    named = manifests.select(F.lower(F.when(cargo, F.replace(bare, F.lit("-"), F.lit("_"))).otherwise(bare)).alias("root")).where(F.octet_length("root") > 1).distinct()
    every = used.unionByName(named.join(used, "root", "left_anti").withColumn("n", F.lit(1).cast("long")))
    return every.orderBy(F.desc("n"), "root").limit(top)


def changed_since(files: DataFrame, since: Column, loaded: Column, *, most: int = PATHS) -> DataFrame:
    """(nth, path, total, overflow): paths of (path, ts) changed since a time; all of them if that is before all were loaded."""
    hit = files.where((since < loaded) | (F.col("ts") >= since)).select("path").distinct()
    total = hit.agg(F.count("*").alias("total"))
    nth = F.row_number().over(Window.orderBy("path")).cast("long")  # at most ``most`` rows
    return hit.orderBy("path").limit(most).withColumn("nth", nth).crossJoin(F.broadcast(total)).select("nth", "path", "total", F.greatest(F.col("total") - most, F.lit(0).cast("long")).alias("overflow"))


def newest_window(commits: DataFrame, most: int, *, since: Column | None = None) -> DataFrame:
    """The ``most`` newest commits (oid, ts), of one time by oid, none before ``since``."""
    kept = commits if since is None else commits.where(F.col("ts") >= since)
    return kept.orderBy(F.desc("ts"), "oid").limit(most)


def of_projects(rows: DataFrame, *, active: str, project: str | None = None, projects: list[str] | None = None) -> DataFrame:
    """Rows (project, ...) of one project, an explicit list, all (``["*"]``), or, asked for neither, the active one."""
    if project is not None and projects is not None:
        raise InvalidQuery("name one project or a list, not both")
    if projects is not None and not projects:
        raise InvalidQuery("the list of projects is empty")
    if projects == ["*"]:
        return rows
    return rows.where(F.col("project").isin(*(projects or [project or active])))


def commitments(events: DataFrame, *, kinds: tuple[str, ...] = COMMITMENTS) -> DataFrame:
    """What counts for recency, of events (call, path, kind, ts): reads and edits, each file once a call; searches never."""
    return events.where(F.col("kind").isin(*kinds)).groupBy("call", "path").agg(F.max("ts").alias("ts"))


def merged(table: DataFrame, rows: DataFrame, keys: list[str], *, mode: str = "replace", add: tuple[str, ...] = ()) -> DataFrame:
    """A kept table with rows written into it, by key.

    ``replace`` writes over rows of the same key, ``ignore`` keeps them, ``add``
    sums the columns named and takes the others as written, ``all`` leaves
    nothing of the table. Of written rows with one key the greatest counts,
    except that ``add`` sums them too.
    """
    value = [c for c in table.columns if c not in keys]
    if mode not in ("replace", "ignore", "add", "all") or set(add) - set(value):
        raise ValueError("mode is replace, ignore, add or all, and only value columns add up")
    greatest = F.max(F.struct(*value)).alias("_v")
    fresh = rows.groupBy(*keys).agg(greatest, *[F.sum(c).alias(f"_{c}") for c in add]).select(*keys, *[F.col(f"_{c}").alias(c) if c in add and mode == "add" else F.col("_v")[c].alias(c) for c in value])
    if mode == "all":
        return fresh.select(*table.columns)
    if mode == "ignore":
        return table.unionByName(fresh.join(table, keys, "left_anti").select(*table.columns))
    if mode == "replace":
        return table.join(fresh, keys, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))
    old = table.select(*keys, F.struct(*value).alias("_o"))
    new = fresh.select(*keys, F.struct(*value).alias("_n"))
    both = old.join(new, keys, "full_outer")
    sums = {c: F.coalesce(F.col("_o")[c], F.lit(0)) + F.coalesce(F.col("_n")[c], F.lit(0)) for c in add}
    return both.select(*keys, *[sums[c].alias(c) if c in sums else F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col("_o")[c]).alias(c) for c in value]).select(*table.columns)


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (path, content) after a batch of edits (path, start, stop, text), as a preview: (path, state, n_edits, content).

    Places count code points of the content as it is; an insertion has start equal
    to stop. A file's edits are made together or not at all: ``overlap`` if two
    touch one place, ``out_of_range``, ``missing`` file, else ``applied``. Of equal
    edits one is made.
    """
    each = edits.select("path", F.struct("start", "stop", "text").alias("e")).distinct()
    per = each.groupBy("path").agg(F.sort_array(F.collect_list("e")).alias("es"))
    met = per.join(files.select("path", F.coalesce("content", F.lit("")).alias("_c"), F.lit(True).alias("_there")), "path", "left")
    later = F.slice("es", 2, F.greatest(F.size("es"), F.lit(1)))
    overlap = F.exists(F.zip_with(F.slice("es", 1, F.size("es") - 1), later, lambda a, b: (b["start"] < a["stop"]) | ((b["start"] == a["start"]) & (b["stop"] == a["stop"]))), lambda x: x)
    outside = F.exists("es", lambda e: (e["start"] < 0) | (e["stop"] < e["start"]) | (e["stop"] > F.length("_c")))
    state = F.when(F.col("_there").isNull(), "missing").when(outside, "out_of_range").when(overlap, "overlap").otherwise("applied")
    # pieces between the edits and the edits' texts, in order
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    fold = F.aggregate("es", start, lambda acc, e: F.struct(e["stop"].cast("long").alias("at"), F.concat(acc["parts"], F.array(F.substring("_c", (acc["at"] + 1).cast("int"), (e["start"] - acc["at"]).cast("int")), e["text"])).alias("parts")))
    whole = F.concat(F.array_join(F.col("_f.parts"), ""), F.substring("_c", (F.col("_f.at") + 1).cast("int"), F.length("_c")))
    return met.withColumn("_f", fold).withColumn("state", state).select("path", "state", F.size("es").cast("long").alias("n_edits"), F.when(F.col("state") == "applied", whole).alias("content"))

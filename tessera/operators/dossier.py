"""Review of kept knowledge: which policy entries hold, what held when, findings by what they mean, and what to do.

Units are (path, hash, ...), the hash being of their text. A policy entry speaks of
a unit as it was (target_hash), so it holds only while the text is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators.knowledge import succession
from tessera.operators.ranking import global_row_number

#: Units that a list of a finding names.
SAMPLES = 8
#: Actions in the order of a plan, and what must be met before each.
ACTIONS = ("mark_superseded", "remove_duplicate", "update", "archive", "needs_review", "keep")


def entries(units: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy entries (entry, target, target_hash, lifecycle, successor, successor_hash) with ``reason``: why one doesn't hold, or null.

    In order: ``cyclic`` (its successors come back to it, or to a cycle),
    ``target_changed``, ``successor_changed``, ``no_successor`` (superseded by nothing).
    """
    links = policy.where("successor IS NOT NULL").select(F.col("target").alias("node"), F.col("successor").alias("next"))
    cyclic = succession(links).where("cyclic").select(F.col("node").alias("target"), F.lit(True).alias("_cyclic"))
    now = units.groupBy("path").agg(F.min("hash").alias("_hash"))
    at = lambda side, name: now.select(F.col("path").alias(side), F.col("_hash").alias(name))
    met = policy.join(cyclic, "target", "left").join(at("target", "_t"), "target", "left").join(at("successor", "_s"), "successor", "left")
    reason = (
        F.when(F.col("_cyclic"), "cyclic")
        .when(~F.col("target_hash").eqNullSafe(F.col("_t")), "target_changed")
        .when(F.col("successor").isNotNull() & ~F.col("successor_hash").eqNullSafe(F.col("_s")), "successor_changed")
        .when((F.col("lifecycle") == "superseded") & F.col("successor").isNull(), "no_successor")
    )
    return met.select("entry", "target", "lifecycle", "successor", reason.alias("reason"))


def timeline(contents: DataFrame, policies: DataFrame) -> DataFrame:
    """Intervals (path, from_ts, until_ts, hash, lifecycle) of texts (path, ts, hash) and policies (path, ts, target_hash, lifecycle).

    The newest policy counts, and only while it speaks of the text that is there;
    else the lifecycle is ``unknown``. Of one time the text comes first. Neighbours
    in which nothing changed are one interval; the last has no end.
    """
    text = contents.select("path", "ts", F.lit(0).alias("_o"), F.struct("hash").alias("_c"), F.lit(None).cast("struct<target_hash:string,lifecycle:string>").alias("_p"))
    rule = policies.select("path", "ts", F.lit(1).alias("_o"), F.lit(None).cast("struct<hash:string>").alias("_c"), F.struct(F.col("target_hash"), F.col("lifecycle")).alias("_p"))
    order = Window.partitionBy("path").orderBy("ts", "_o", "_c", "_p")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = text.unionByName(rule).withColumn("c", F.last("_c", ignorenulls=True).over(so_far)).withColumn("p", F.last("_p", ignorenulls=True).over(so_far))
    state = held.select("path", "ts", "_o", "_c", "_p", F.col("c.hash").alias("hash"), F.when(F.col("p.target_hash") == F.col("c.hash"), F.col("p.lifecycle")).otherwise("unknown").alias("lifecycle"))
    # of one time the last state counts, then only states that differ from the one before
    last = state.withColumn("_next", F.lead("ts").over(order)).where("_next IS NULL OR _next <> ts")
    by_time = Window.partitionBy("path").orderBy("ts")
    before = F.lag(F.struct("hash", "lifecycle")).over(by_time)
    turns = last.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct("hash", "lifecycle")))
    return turns.select("path", F.col("ts").alias("from_ts"), F.lead("ts").over(by_time).alias("until_ts"), "hash", "lifecycle")


def as_of(intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """What held of (path, at): (path, at, hash, lifecycle); null before a path's first interval."""
    inside = (F.col("_at") >= F.col("from_ts")) & (F.col("until_ts").isNull() | (F.col("_at") < F.col("until_ts")))
    wanted = asked.select(F.col("path").alias("_path"), F.col("at").alias("_at"))
    return wanted.join(intervals, (F.col("_path") == F.col("path")) & inside, "left").select(F.col("_path").alias("path"), F.col("_at").alias("at"), "hash", "lifecycle")


def finding_index(findings: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """(finding, n_units, units): what each finding of (finding, path) is about, the first paths of all."""
    bucket = F.pmod(F.xxhash64("path"), F.lit(64))  # a common finding's paths are cut down in buckets first
    least = lambda c: F.slice(F.array_sort(c), 1, samples)
    parts = findings.select("finding", "path").distinct().groupBy("finding", bucket.alias("_b")).agg(F.count("*").alias("n"), least(F.collect_list("path")).alias("u"))
    return parts.groupBy("finding").agg(F.sum("n").alias("n_units"), F.array_join(least(F.flatten(F.collect_list("u"))), ",").alias("units"))


def copies(units: DataFrame) -> DataFrame:
    """Units (path, hash) with ``copies`` of their text and ``retained``: the least path that has it, where that is another one."""
    same = units.groupBy("hash").agg(F.count_distinct("path").alias("copies"), F.min("path").alias("_least"))
    met = units.join(same, "hash", "left")
    return met.select(*units.columns, F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.when(F.col("_least") != F.col("path"), F.col("_least")).alias("retained"))


def dossiers(records: DataFrame) -> DataFrame:
    """Records with action, confidence and preconditions.

    Records are (path, lifecycle, domain, voice, display, successor, retained,
    inbound, protected): ``inbound`` current links that point at the unit,
    ``protected`` whether a role keeps it. Removing a copy needs its links moved
    first, and somebody's judgement if it is protected.
    """
    action = (
        F.when((F.col("lifecycle") == "superseded") & F.col("successor").isNotNull(), "mark_superseded")
        .when(F.col("retained").isNotNull(), "remove_duplicate")
        .when(F.col("voice") == "current", "keep")
        .when((F.col("voice") == "intent") & (F.col("display") == "implementation_gap"), "update")
        .when((F.col("voice") == "history_only") & (F.col("domain") == "historical_record"), "archive")
        .otherwise("needs_review")
    )
    sure = F.when(F.col("action").isin("mark_superseded", "keep"), "deterministic").when(F.col("action") == "needs_review", "signal").otherwise("strong")
    needs = F.array_compact(
        F.array(
            F.when((F.col("action") == "remove_duplicate") & (F.col("inbound") > 0), "move_links"),
            F.when((F.col("action") == "remove_duplicate") & F.col("protected"), "protected_role"),
            F.when(F.col("action").isin("update", "archive"), "user_judgment"),
        )
    )
    return records.withColumn("action", action).withColumn("confidence", sure).withColumn("preconditions", F.array_join(needs, ","))


def totals(records: DataFrame) -> DataFrame:
    """(fact, value, n): records of :func:`dossiers` by lifecycle, domain, display, voice and action, copies and protected ones, and all."""
    facts = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("fact"), F.col(c).alias("value"))) for c in ("lifecycle", "domain", "display", "voice", "action")]
    flags = [F.when(c, F.struct(F.lit("flag").alias("fact"), F.lit(n).alias("value"))) for n, c in (("copy", F.col("retained").isNotNull()), ("protected", F.col("protected")), ("all", F.lit(True)))]
    return records.select(F.explode(F.array_compact(F.array(*facts, *flags))).alias("f")).groupBy("f.fact", "f.value").agg(F.count("*").alias("n"))


def plan(records: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` steps (nth, path, action, confidence, preconditions, steps) of all ``steps`` that are to be taken.

    Steps without preconditions come first, then by action and path; what is kept is no step.
    """
    place = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    todo = records.where("action <> 'keep'").withColumn("_blocked", F.col("preconditions") != "").withColumn("_place", place)
    ranked = global_row_number(todo, ["_blocked", "_place", "path"], "nth")
    return ranked.where(F.col("nth") <= budget).select(F.col("nth").cast("long").alias("nth"), "path", "action", "confidence", "preconditions", F.col("nth_of").cast("long").alias("steps"))

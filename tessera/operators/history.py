"""Churn, ownership, co-change and access recency over change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ranking import global_row_number

LN2 = 0.6931471805599453


def decay(age: Column, half_life: float) -> Column:
    """exp(-ln 2 * age / half_life); times in the future count as now."""
    return F.exp(-F.lit(LN2) * F.greatest(age, F.lit(0.0)) / half_life)


def age_days(ts: str, now: str) -> Column:
    """Days, with fractions, from a column's time to ``now``."""
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return micros / 86400e6


def churn(log: DataFrame, now: str, *, half_life: float = 14.0) -> DataFrame:
    """Per path of (oid, path, ts): commits and decayed churn."""
    # dealt out first, so that a task doesn't hold what the log was joined by as well
    return log.repartition("path", "oid").groupBy("path").agg(F.count_distinct("oid").alias("commits"), F.sum(decay(age_days("ts", now), half_life)).alias("churn"))


def churn_rank(churned: DataFrame) -> DataFrame:
    """Churn as a place from 0 to 1 (a single path: 1 if it has any; ties by path), with a label."""
    ranked = global_row_number(churned, ["churn", "path"], "nth")
    place = F.when(F.col("nth_of") == 1, (F.col("churn") > 0).cast("double")).otherwise((F.col("nth") - 1) / F.greatest(F.col("nth_of") - 1, F.lit(1)))
    label = F.when(place >= 0.8, "very high").when(place >= 0.6, "high").when(place >= 0.4, "medium").when(place >= 0.2, "low").otherwise("very low")
    return ranked.withColumn("place", F.round(place, 6)).withColumn("label", label).drop("nth", "nth_of")


def ownership(log: DataFrame, *, top: int = 5) -> DataFrame:
    """Per path of (oid, path, author): the authors with most commits and their shares."""
    # dealt out first, as in churn
    each = log.repartition("path", "author", "oid").groupBy("path", "author").agg(F.count_distinct("oid").alias("commits"))
    whole = Window.partitionBy("path")
    ranked = each.withColumn("share", F.round(100.0 * F.col("commits") / F.sum("commits").over(whole), 6)).withColumn("nth", F.row_number().over(whole.orderBy(F.desc("commits"), "author")).cast("long"))
    return ranked.where(F.col("nth") <= top)


def latest(log: DataFrame) -> DataFrame:
    """Per path the newest commit (the smaller oid of equals)."""
    return log.groupBy("path").agg(F.max_by("oid", F.struct("ts", -F.col("oid"))).alias("oid"), F.max("ts").alias("ts"))


def _gathered(log: DataFrame, most_files: int, *more: Column) -> DataFrame:
    """(oid, paths) of commits of 2 to ``most_files`` different paths, sorted, with ``more`` aggregates of their rows.

    One sort a task: of a large commit only one path more than fits is gathered,
    which tells that it is too large.
    """
    nth = F.dense_rank().over(Window.partitionBy("oid").orderBy("path"))
    first = log.where("oid IS NOT NULL AND path IS NOT NULL").withColumn("_nth", nth).where(F.col("_nth") <= most_files + 1)
    return first.groupBy("oid").agg(F.array_sort(F.collect_set("path")).alias("paths"), *more).where(F.size("paths").between(2, most_files))


def _opened(small: DataFrame, most_files: int, *keep: str) -> DataFrame:
    each = small.select("oid", "paths", *keep, F.posexplode("paths").alias("at", "a"))
    return each.select("oid", "a", F.explode(F.slice("paths", F.col("at") + 2, most_files)).alias("b"), *keep)


def pairs(log: DataFrame, *, most_files: int = 50) -> DataFrame:
    """(oid, a, b) with a < b for paths of one commit; commits of more than ``most_files`` make none, so a commit's pairs are bounded."""
    return _opened(_gathered(log.select("oid", "path"), most_files), most_files)


def co_change(log: DataFrame, *, shared: int = 2, least: float = 0.15, most_files: int = 50) -> DataFrame:
    """Jaccard of commits for pairs of paths; large commits stay in the denominators."""
    counts = log.select("path", "oid").repartition("path", "oid").groupBy("path").agg(F.count_distinct("oid").alias("n"))
    # a pair occurs once a commit
    both = pairs(log, most_files=most_files).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    left, right = counts.select(F.col("path").alias("a"), F.col("n").alias("na")), counts.select(F.col("path").alias("b"), F.col("n").alias("nb"))
    out = both.join(left, "a").join(right, "b")
    return out.withColumn("jaccard", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6)).where(F.col("jaccard") >= least)


def co_change_bands(log: DataFrame, *, shared: int = 2, strong: float = 0.15, weak: float = 0.05, most_files: int = 50, top_strong: int = 5, top_weak: int = 3) -> DataFrame:
    """Per path its strong partners (enough shared commits and a high Jaccard) and its weak ones (any shared commit, a lower Jaccard), the best of each band."""
    edges = co_change(log, shared=1, least=weak, most_files=most_files)
    band = F.when((F.col("shared") >= shared) & (F.col("jaccard") >= strong), "strong").otherwise("weak")
    every = both_ways(edges.select("a", "b", "shared", "jaccard", band.alias("band")))
    nth = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("jaccard"), F.desc("shared"), "partner")).cast("long")
    return every.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("band") == "strong", top_strong).otherwise(top_weak))


def repository_history(log: DataFrame, *, most: int = 10, **bands) -> DataFrame:
    """Totals (commits, paths, authors), the paths with most commits and the strongest pairs: (fact, a, b, value)."""
    totals = log.agg(F.count_distinct("oid").alias("commits"), F.count_distinct("path").alias("paths"), F.count_distinct("author").alias("authors"))
    none = F.lit(None).cast("string")
    total = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("a"), F.col(c).cast("double").alias("value")) for c in totals.columns])).alias("t")).select(F.lit("total").alias("fact"), "t.a", none.alias("b"), "t.value")
    hot = log.groupBy("path").agg(F.count_distinct("oid").cast("double").alias("value")).orderBy(F.desc("value"), "path").limit(most).select(F.lit("hotspot").alias("fact"), F.col("path").cast("string").alias("a"), none.alias("b"), "value")
    pair = co_change(log, **bands).orderBy(F.desc("jaccard"), F.desc("shared"), "a", "b").limit(most).select(F.lit("pair").alias("fact"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("jaccard").alias("value"))
    return total.unionByName(hot).unionByName(pair)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b, ...) as (anchor, partner, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("anchor"), F.col("b").alias("partner"), *rest).unionByName(edges.select(F.col("b").alias("anchor"), F.col("a").alias("partner"), *rest))


def top_partners(edges: DataFrame, order: list, *, top: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(*order)).cast("long")
    return edges.withColumn("nth", nth).where(F.col("nth") <= top)


def ledger(log: DataFrame, *, most_files: int = 200) -> DataFrame:
    """A row for each commit and pair: base weight 1 / log2(files + 1) and the commit's time."""
    small = _gathered(log.select("oid", "path", "ts"), most_files, F.max("ts").alias("ts"))
    sized = small.withColumn("base", 1.0 / F.log2(F.size("paths") + 1))
    return _opened(sized, most_files, "base", "ts")


def weighted(ledger_: DataFrame, now: str, *, half_life: float = 30.0) -> DataFrame:
    """Per pair: shared commits, decayed weight and newest time."""
    return ledger_.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("base") * decay(age_days("ts", now), half_life)).alias("weight"), F.max("ts").alias("last_ts"))


def advance(state: DataFrame, ledger_: DataFrame, incoming: DataFrame, outgoing: DataFrame, *, before: str, now: str, half_life: float = 30.0) -> DataFrame:
    """The state of :func:`weighted` moved from ``before`` to ``now``.

    ``incoming`` and ``outgoing`` are ledger rows. Old weights are scaled by the
    decay of the time between, rows that left are taken off, new ones added,
    pairs without commits go; the newest time is found again for pairs that lost
    rows. Only pairs that changed are grouped with the ledger.
    """
    scale = decay((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(before).cast("timestamp"))) / 86400.0, half_life)
    old = state.select("a", "b", "shared", (F.col("weight") * scale).alias("weight"), "last_ts")
    delta = lambda rows, sign: rows.select("a", "b", F.lit(sign).cast("long").alias("shared"), (sign * F.col("base") * decay(age_days("ts", now), half_life)).alias("weight"), (F.col("ts") if sign > 0 else F.lit(None).cast(rows.schema["ts"].dataType)).alias("last_ts"))
    summed = old.unionByName(delta(incoming, 1)).unionByName(delta(outgoing, -1)).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("weight").alias("weight"), F.max("last_ts").alias("seen")).where("shared > 0")
    lost = outgoing.select("a", "b").distinct()
    left = ledger_.join(lost, ["a", "b"], "left_semi").join(outgoing.select("oid", "a", "b"), ["oid", "a", "b"], "left_anti").unionByName(incoming.join(lost, ["a", "b"], "left_semi"))
    again = left.groupBy("a", "b").agg(F.max("ts").alias("again"))
    return summed.join(again, ["a", "b"], "left").select("a", "b", "shared", "weight", F.coalesce("again", "seen").alias("last_ts"))


def frecency(access: DataFrame, now: str, *, half_life: float = 7.0) -> DataFrame:
    """Per path: hits, last access and hits * decay of the time since."""
    per = access.groupBy("path").agg(F.count("*").alias("hits"), F.max("ts").alias("last_ts"))
    return per.withColumn("frecency", F.round(F.col("hits") * decay(age_days("last_ts", now), half_life), 6))


def frecency_reset(stats: DataFrame, distance: Column) -> DataFrame:
    """Hits after a move of ``distance`` commits: kept below 50, halved to 500, else (or unrelated: null) none."""
    kept = F.when(distance < 50, F.col("hits")).when(distance <= 500, F.floor(F.col("hits") / 2)).otherwise(F.lit(0))
    return stats.withColumn("hits_after", kept.cast("long"))

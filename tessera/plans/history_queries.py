"""Registered change-log queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.plans.registry import query
from tessera.scratch import cut
from tessera.sources import tables as T

NOW, BEFORE = "2001-08-02 00:00:00", "2001-06-01 00:00:00"
_LOG = "WITH log AS (SELECT DISTINCT l_orderkey AS oid, lower(p_type) || '/' || p_brand AS path, o_orderdate AS ts, o_custkey AS author FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
_AGE = "(epoch(TIMESTAMP '{now}') - epoch({ts})) / 86400.0"


def _decay(ts: str, half: float, now: str = NOW) -> str:
    return f"exp(-0.6931471805599453 * greatest({_AGE.format(now=now, ts=ts)}, 0.0) / {half})"


def log(spark, d):
    return T.commit_files(spark, d).join(T.commits(spark, d), "oid")


@query("churn", f"""{_LOG}, c AS (SELECT path, count(DISTINCT oid) AS commits, sum({_decay('ts', 14.0)}) AS churn FROM log GROUP BY path),
p AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN CAST(churn > 0 AS DOUBLE) ELSE (row_number() OVER (ORDER BY churn, path) - 1) / (count(*) OVER () - 1) END AS place FROM c)
SELECT path, commits, round(churn, 6) AS churn, round(place, 6) AS place, CASE WHEN place >= 0.8 THEN 'very high' WHEN place >= 0.6 THEN 'high' WHEN place >= 0.4 THEN 'medium' WHEN place >= 0.2 THEN 'low' ELSE 'very low' END AS label FROM p""")
def churn(spark, d):
    return H.churn_rank(H.churn(log(spark, d), NOW)).withColumn("churn", F.round("churn", 6))


@query("ownership", f"""{_LOG}, e AS (SELECT path, author, count(DISTINCT oid) AS commits FROM log GROUP BY ALL),
r AS (SELECT *, round(100.0 * commits / sum(commits) OVER (PARTITION BY path), 6) AS share, row_number() OVER (PARTITION BY path ORDER BY commits DESC, author) AS nth FROM e)
SELECT path, author, commits, CAST(share AS DOUBLE) AS share, nth FROM r WHERE nth <= 5""")
def ownership(spark, d):
    return H.ownership(log(spark, d))


@query("latest_commit", f"{_LOG} SELECT path, oid, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, oid) AS nth FROM log) WHERE nth = 1")
def latest_commit(spark, d):
    return H.latest(log(spark, d))


_PAIRS = "small AS (SELECT oid FROM log GROUP BY oid HAVING count(DISTINCT path) BETWEEN 2 AND {most}), pairs AS (SELECT x.oid, x.path AS a, y.path AS b, x.ts FROM log x JOIN log y ON x.oid = y.oid AND x.path < y.path WHERE x.oid IN (SELECT oid FROM small))"


@query("co_change_jaccard", f"""{_LOG}, {_PAIRS.format(most=50)}, n AS (SELECT path, count(DISTINCT oid) AS n FROM log GROUP BY path), s AS (SELECT a, b, count(DISTINCT oid) AS shared FROM pairs GROUP BY a, b HAVING count(DISTINCT oid) >= 2)
SELECT * FROM (SELECT s.a, s.b, shared, x.n AS na, y.n AS nb, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON s.a = x.path JOIN n y ON s.b = y.path) WHERE jaccard >= 0.012""")
def co_change_jaccard(spark, d):
    return H.co_change(log(spark, d), least=0.012)


_JACCARD = f"""{_LOG}, {_PAIRS.format(most=50)}, n AS (SELECT path, count(DISTINCT oid) AS n FROM log GROUP BY path), s AS (SELECT a, b, count(DISTINCT oid) AS shared FROM pairs GROUP BY a, b HAVING count(DISTINCT oid) >= 2),
j AS (SELECT s.a, s.b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON s.a = x.path JOIN n y ON s.b = y.path)"""


@query("co_change_partners", f"""{_JACCARD}, e AS (SELECT a AS anchor, b AS partner, shared, jaccard FROM j UNION ALL SELECT b, a, shared, jaccard FROM j)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY jaccard DESC, shared DESC, partner) AS nth FROM e) WHERE nth <= 5""")
def co_change_partners(spark, d):
    edges = H.co_change(log(spark, d), least=0.0).select("a", "b", "shared", "jaccard")
    return H.top_partners(H.both_ways(edges), [F.desc("jaccard"), F.desc("shared"), F.col("partner")], top=5)


#: A log in which paths often change together: types of parts and, for small parts, brands.
_DENSE = "WITH log AS (SELECT DISTINCT l_orderkey AS oid, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS path, o_custkey % 40 AS author FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"
_DENSE_J = f"""{_DENSE}, {_PAIRS.format(most=50).replace(", x.ts", "")}, n AS (SELECT path, count(DISTINCT oid) AS n FROM log GROUP BY path), s AS (SELECT a, b, count(DISTINCT oid) AS shared FROM pairs GROUP BY a, b),
j AS (SELECT s.a, s.b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON s.a = x.path JOIN n y ON s.b = y.path)"""


def _dense(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand")).alias("path"))
    orders = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 40).alias("author"))
    return T.table(spark, d, "lineitem").join(parts, "l_partkey").join(orders, "l_orderkey").select(F.col("l_orderkey").alias("oid"), "path", "author").distinct()


@query("co_change_bands", f"""{_DENSE_J}, e AS (SELECT a AS anchor, b AS partner, shared, jaccard FROM j WHERE jaccard >= 0.05 UNION ALL SELECT b, a, shared, jaccard FROM j WHERE jaccard >= 0.05),
k AS (SELECT *, CASE WHEN shared >= 2 AND jaccard >= 0.15 THEN 'strong' ELSE 'weak' END AS band FROM e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, band ORDER BY jaccard DESC, shared DESC, partner) AS nth FROM k) WHERE nth <= CASE band WHEN 'strong' THEN 5 ELSE 3 END""")
def co_change_bands(spark, d):
    return H.co_change_bands(_dense(spark, d))


@query("repository_history", f"""{_DENSE_J}, t AS (SELECT count(DISTINCT oid) AS commits, count(DISTINCT path) AS paths, count(DISTINCT author) AS authors FROM log)
SELECT 'total' AS fact, 'commits' AS a, NULL AS b, CAST(commits AS DOUBLE) AS value FROM t UNION ALL SELECT 'total', 'paths', NULL, paths FROM t UNION ALL SELECT 'total', 'authors', NULL, authors FROM t
UNION ALL (SELECT 'hotspot', path, NULL, CAST(count(DISTINCT oid) AS DOUBLE) AS v FROM log GROUP BY path ORDER BY v DESC, path LIMIT 10)
UNION ALL (SELECT 'pair', a, b, jaccard FROM j WHERE shared >= 2 AND jaccard >= 0.15 ORDER BY jaccard DESC, shared DESC, a, b LIMIT 10)""")
def repository_history(spark, d):
    return H.repository_history(_dense(spark, d))


@query("hotspots", f"{_LOG} SELECT path, count(DISTINCT oid) AS commits, count(DISTINCT author) AS authors FROM log GROUP BY path ORDER BY commits DESC, path LIMIT 10")
def hotspots(spark, d):
    return log(spark, d).groupBy("path").agg(F.count_distinct("oid").alias("commits"), F.count_distinct("author").alias("authors")).orderBy(F.desc("commits"), "path").limit(10)


_LEDGER = f"{_LOG}, {_PAIRS.format(most=200)}, z AS (SELECT oid, count(DISTINCT path) AS files FROM log GROUP BY oid), ledger AS (SELECT pairs.oid, a, b, 1.0 / log2(files + 1) AS base, ts FROM pairs JOIN z ON pairs.oid = z.oid)"
_WEIGHTED = "SELECT a, b, count(*) AS shared, round(sum(base * {decay}), 6) AS weight, max(ts) AS last_ts FROM ledger WHERE ts >= TIMESTAMP '{since}' AND ts < TIMESTAMP '{until}' GROUP BY a, b"


@query("co_change_weighted", f"{_LEDGER} {_WEIGHTED.format(decay=_decay('ts', 30.0), since='1998-08-02', until='2001-08-02')}")
def co_change_weighted(spark, d):
    rows = H.ledger(log(spark, d)).where("ts >= TIMESTAMP '1998-08-02' AND ts < TIMESTAMP '2001-08-02'")
    return H.weighted(rows, NOW).withColumn("weight", F.round("weight", 6))


@query("co_change_incremental", f"{_LEDGER} {_WEIGHTED.format(decay=_decay('ts', 30.0), since='1999-08-02', until='2001-08-02')}")
def co_change_incremental(spark, d):
    """The state of an earlier window moved on; the SQL builds the later window anew."""
    some = log(spark, d).where("ts >= TIMESTAMP '1999-06-01' AND ts < TIMESTAMP '2001-08-02'")  # what either window holds
    rows = cut(H.ledger(some), "ledger")  # a kept table, as the state is; read for each part below
    old = rows.where("ts >= TIMESTAMP '1999-06-01' AND ts < TIMESTAMP '2001-06-01'")
    outgoing = old.where("ts < TIMESTAMP '1999-08-02'")
    incoming = rows.where("ts >= TIMESTAMP '2001-06-01' AND ts < TIMESTAMP '2001-08-02'")
    moved = H.advance(H.weighted(old, BEFORE), old, incoming, outgoing, before=BEFORE, now=NOW)
    return moved.withColumn("weight", F.round(F.abs("weight"), 6))


_ACCESS_NOW = "2024-01-31 00:00:00"
_FREC = f"SELECT json_extract_string(props, '$.k') AS path, count(*) AS hits, max(ts) AS last_ts, round(count(*) * {_decay('max(ts)', 7.0, _ACCESS_NOW)}, 6) AS frecency FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1"


def _stats(spark, d):
    committed = T.access(spark, d).where(F.col("event_type").isin("click", "purchase"))
    return H.frecency(committed.select("path", "ts"), _ACCESS_NOW)


@query("frecency", _FREC)
def frecency(spark, d):
    return _stats(spark, d)


@query("frecency_reset", f"SELECT path, hits, CAST(CASE WHEN CAST(path AS INTEGER) * 7 < 50 THEN hits WHEN CAST(path AS INTEGER) * 7 <= 500 THEN hits // 2 ELSE 0 END AS BIGINT) AS hits_after FROM ({_FREC})")
def frecency_reset(spark, d):
    return H.frecency_reset(_stats(spark, d), F.col("path").cast("int") * 7).select("path", "hits", "hits_after")


@query("frecency_fusion", f"SELECT path, round(CAST(0.9 AS DOUBLE) * CASE WHEN contains(path, '7') THEN 1.0 ELSE 0.1 END + CAST(0.1 AS DOUBLE) * frecency / max(frecency) OVER (), 6) AS score FROM ({_FREC}) ORDER BY score DESC, path LIMIT 20")
def frecency_fusion(spark, d):
    stats = _stats(spark, d)
    top = stats.agg(F.max("frecency").alias("most"))
    score = 0.9 * F.when(F.col("path").contains("7"), 1.0).otherwise(0.1) + 0.1 * F.col("frecency") / F.col("most")
    return stats.crossJoin(F.broadcast(top)).select("path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(20)

"""Policy entries, timelines, findings, dossiers and plans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dossier as D
from tessera.plans.registry import query
from tessera.sources import tables as T


@query("policy_entries", """WITH RECURSIVE u AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS VARCHAR) AS hash FROM part),
e AS (SELECT p_partkey AS entry, CAST(p_partkey AS VARCHAR) AS target, CAST(CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS target_hash, CASE WHEN p_partkey % 4 < 2 THEN 'superseded' ELSE 'active' END AS lifecycle,
CASE WHEN p_partkey % 4 = 0 THEN CAST(CASE WHEN p_partkey % 40 = 0 THEN p_partkey - p_partkey % 200 + (p_partkey + 40) % 200 ELSE p_partkey + 1 END AS VARCHAR) END AS successor FROM part),
f AS (SELECT e.*, CASE WHEN e.entry % 7 = 0 THEN '?' ELSE s.hash END AS successor_hash, s.hash AS now FROM e LEFT JOIN u s ON s.path = e.successor),
l AS (SELECT target AS node, successor AS next FROM f WHERE successor IS NOT NULL), w(node, there, hop) AS (SELECT node, next, 1 FROM l UNION ALL SELECT w.node, l.next, hop + 1 FROM w JOIN l ON l.node = w.there WHERE hop < 12), c AS (SELECT DISTINCT node FROM w WHERE hop = 12)
SELECT f.entry, f.target, f.lifecycle, f.successor, CASE WHEN c.node IS NOT NULL THEN 'cyclic' WHEN f.target_hash IS DISTINCT FROM u.hash THEN 'target_changed' WHEN f.successor IS NOT NULL AND f.successor_hash IS DISTINCT FROM f.now THEN 'successor_changed' WHEN f.lifecycle = 'superseded' AND f.successor IS NULL THEN 'no_successor' END AS reason FROM f LEFT JOIN u ON u.path = f.target LEFT JOIN c ON c.node = f.target""")
def policy_entries(spark, d):
    parts, k = T.table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    units = parts.select(k.cast("string").alias("path"), F.col("p_size").cast("string").alias("hash"))
    ring = k - k % 200 + (k + 40) % 200
    told = parts.select(
        k.alias("entry"), k.cast("string").alias("target"), F.when(k % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string").alias("target_hash"), F.when(k % 4 < 2, "superseded").otherwise("active").alias("lifecycle"),
        F.when(k % 4 == 0, F.when(k % 40 == 0, ring).otherwise(k + 1).cast("string")).alias("successor"),
    )
    known = units.select(F.col("path").alias("successor"), F.col("hash").alias("h"))
    policy = told.join(known, "successor", "left").withColumn("successor_hash", F.when(F.col("entry") % 7 == 0, "?").otherwise(F.col("h"))).drop("h")
    return D.entries(units, policy)


_EVENTS = """WITH x AS (SELECT json_extract_string(props, '$.k') AS path, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS h, CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS t, CASE WHEN event_type = 'purchase' THEN CASE WHEN CAST(floor(value * 10) AS BIGINT) % 2 = 0 THEN 'active' ELSE 'draft' END END AS l FROM events WHERE event_type IN ('view', 'click', 'purchase')),
y AS (SELECT path, ts, last_value(h IGNORE NULLS) OVER w AS hash, last_value(t IGNORE NULLS) OVER w AS t, last_value(l IGNORE NULLS) OVER w AS l FROM x WINDOW w AS (PARTITION BY path ORDER BY ts, t IS NOT NULL, event_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT path, ts, hash, CASE WHEN t = hash THEN l ELSE 'unknown' END AS lifecycle FROM y),
b AS (SELECT *, lag(hash) OVER o AS ph, lag(lifecycle) OVER o AS pl, row_number() OVER o AS nth FROM z WINDOW o AS (PARTITION BY path ORDER BY ts)),
i AS (SELECT path, ts AS from_ts, lead(ts) OVER (PARTITION BY path ORDER BY ts) AS until_ts, hash, lifecycle FROM b WHERE nth = 1 OR ph IS DISTINCT FROM hash OR pl IS DISTINCT FROM lifecycle)"""


def _timeline(spark, d):
    events = T.table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("path"), "ts", "event_type", (F.floor("value") % 3).cast("string").alias("h"), F.when(F.floor(F.col("value") * 10) % 2 == 0, "active").otherwise("draft").alias("lifecycle"))
    contents = events.where("event_type IN ('view', 'click')").select("path", "ts", F.col("h").alias("hash"))
    return D.timeline(contents, events.where("event_type = 'purchase'").select("path", "ts", F.col("h").alias("target_hash"), "lifecycle"))


@query("authority_timeline", f"{_EVENTS} SELECT * FROM i")
def authority_timeline(spark, d):
    return _timeline(spark, d)


@query("authority_as_of", f"{_EVENTS}, a AS (SELECT DISTINCT json_extract_string(props, '$.k') AS path FROM events) SELECT a.path, TIMESTAMP '2024-01-05' AS at_, i.hash, i.lifecycle FROM a LEFT JOIN i ON i.path = a.path AND from_ts <= TIMESTAMP '2024-01-05' AND (until_ts IS NULL OR until_ts > TIMESTAMP '2024-01-05')")
def authority_as_of(spark, d):
    asked = T.table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("path")).distinct().withColumn("at", F.lit("2024-01-05").cast("timestamp_ntz"))
    return D.as_of(_timeline(spark, d), asked).withColumnRenamed("at", "at_")


@query("finding_index", """WITH f AS (SELECT DISTINCT p_type AS finding, CAST(l_suppkey AS VARCHAR) AS path FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT finding, count(*) AS n_units, array_to_string(list(path ORDER BY path)[1:8], ',') AS units FROM f GROUP BY finding""")
def finding_index(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("finding"))
    return D.finding_index(T.table(spark, d, "lineitem").join(parts, "l_partkey").select("finding", F.col("l_suppkey").cast("string").alias("path")))


_RECORDS = """WITH u AS (SELECT source || '/' || doc_id AS path, md5(coalesce(text, '')) AS hash, lang, doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT hash, count(DISTINCT path) AS copies, min(path) AS least FROM u GROUP BY hash),
r AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'superseded' ELSE 'active' END AS lifecycle, CASE lang WHEN 'en' THEN 'historical_record' ELSE 'guide' END AS domain, CASE WHEN quality = 1 THEN 'current' WHEN quality = 0 THEN 'intent' ELSE 'history_only' END AS voice, CASE WHEN coalesce(toxic, 0) = 1 OR doc_id % 3 = 0 THEN 'implementation_gap' ELSE 'consistent' END AS display, CASE WHEN doc_id % 26 = 0 THEN 'next' END AS successor, CASE WHEN least <> path THEN least END AS retained, n_chars % 3 AS inbound, doc_id % 5 = 0 AS protected FROM u JOIN s USING (hash)),
a AS (SELECT *, CASE WHEN lifecycle = 'superseded' AND successor IS NOT NULL THEN 'mark_superseded' WHEN retained IS NOT NULL THEN 'remove_duplicate' WHEN voice = 'current' THEN 'keep' WHEN voice = 'intent' AND display = 'implementation_gap' THEN 'update' WHEN voice = 'history_only' AND domain = 'historical_record' THEN 'archive' ELSE 'needs_review' END AS action FROM r),
d AS (SELECT *, CASE WHEN action IN ('mark_superseded', 'keep') THEN 'deterministic' WHEN action = 'needs_review' THEN 'signal' ELSE 'strong' END AS confidence, array_to_string(list_filter([CASE WHEN action = 'remove_duplicate' AND inbound > 0 THEN 'move_links' END, CASE WHEN action = 'remove_duplicate' AND protected THEN 'protected_role' END, CASE WHEN action IN ('update', 'archive') THEN 'user_judgment' END], lambda x: x IS NOT NULL), ',') AS preconditions FROM a)"""


def _records(spark, d):
    docs = T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id", "left").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).withColumn("hash", F.md5(F.coalesce("text", F.lit(""))))
    n = F.col("doc_id")
    units = D.copies(docs.select("path", "hash", "lang", "doc_id", "n_chars", "quality", "toxic"))
    return D.dossiers(units.select("path", F.when(n % 13 == 0, "superseded").otherwise("active").alias("lifecycle"), F.when(F.col("lang") == "en", "historical_record").otherwise("guide").alias("domain"), F.when(F.col("quality") == 1, "current").when(F.col("quality") == 0, "intent").otherwise("history_only").alias("voice"), F.when((F.coalesce("toxic", F.lit(0)) == 1) | (n % 3 == 0), "implementation_gap").otherwise("consistent").alias("display"), F.when(n % 26 == 0, "next").alias("successor"), "retained", (F.col("n_chars") % 3).alias("inbound"), (n % 5 == 0).alias("protected")))


@query("dossiers", f"{_RECORDS} SELECT path, action, confidence, preconditions, retained FROM d")
def dossiers(spark, d):
    return _records(spark, d).select("path", "action", "confidence", "preconditions", "retained")


@query("review_totals", f"{_RECORDS} SELECT fact, value, count(*) AS n FROM (SELECT unnest([{{'f': 'lifecycle', 'v': lifecycle}}, {{'f': 'domain', 'v': domain}}, {{'f': 'display', 'v': display}}, {{'f': 'voice', 'v': voice}}, {{'f': 'action', 'v': action}}, {{'f': 'flag', 'v': CASE WHEN retained IS NOT NULL THEN 'copy' END}}, {{'f': 'flag', 'v': CASE WHEN protected THEN 'protected' END}}, {{'f': 'flag', 'v': 'all'}}]) AS x FROM d), (SELECT 1), LATERAL (SELECT x.f AS fact, x.v AS value) WHERE value IS NOT NULL GROUP BY fact, value")
def review_totals(spark, d):
    return D.totals(_records(spark, d))


@query("remediation_plan", f"{_RECORDS}, n AS (SELECT *, row_number() OVER (ORDER BY preconditions <> '', list_position(['mark_superseded', 'remove_duplicate', 'update', 'archive', 'needs_review', 'keep'], action), path) AS nth, count(*) OVER () AS steps FROM d WHERE action <> 'keep') SELECT nth, path, action, confidence, preconditions, steps FROM n WHERE nth <= 100")
def remediation_plan(spark, d):
    return D.plan(_records(spark, d), 100)

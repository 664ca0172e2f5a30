"""Registered admission, health, telemetry and knowledge queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import admission as A
from tessera.plans.registry import query
from tessera.sources import tables as T

_FILES = "WITH files AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, lang AS language, source, coalesce(text, '') AS content, octet_length(encode(coalesce(text, ''))) AS byte_len FROM documents)"


@query("repo_map", f"{_FILES} SELECT language, source, count(*) AS n_files, CAST(sum(byte_len) AS BIGINT) AS bytes FROM files GROUP BY GROUPING SETS ((), (language), (source))")
def repo_map(spark, d):
    return T.files(spark, d).groupingSets([[], ["language"], ["source"]], "language", "source").agg(F.count("*").alias("n_files"), F.sum("byte_len").alias("bytes"))


@query("admission_tiers", f"""{_FILES} SELECT tier, count(*) AS n FROM (SELECT CASE WHEN byte_len > 104857600 THEN 'hard_skip' WHEN doc_id % 101 = 0 THEN 'lockfile' WHEN doc_id % 97 = 0 THEN 'denied' WHEN language = 'de' AND byte_len > 1048576 THEN 'too_large' WHEN language <> 'de' AND byte_len > 4194304 THEN 'too_large'
WHEN len(regexp_extract_all(content[1:8192], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) / greatest(length(content[1:8192]), 1) > 0.3 THEN 'binary' ELSE 'normal' END AS tier FROM files) GROUP BY tier""")
def admission_tiers(spark, d):
    chosen = A.tier(F.col("byte_len"), F.col("language") == "de", F.col("doc_id") % 97 == 0, F.col("doc_id") % 101 == 0, A.control_share(F.col("content")) > 0.3)
    return T.files(spark, d).groupBy(chosen.alias("tier")).agg(F.count("*").alias("n"))


_RULES = {"assignment": r"(password|secret|token) ?[:=]", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "mail": r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+"}


@query("sensitive_screen", f"""{_FILES}, c AS (SELECT path, {', '.join(f"len(regexp_extract_all(content, '{p}')) AS {r}" for r, p in _RULES.items())} FROM files)
SELECT path, CASE WHEN {' + '.join(_RULES)} > 0 THEN 'sensitive' ELSE 'clean' END AS state, array_to_string(list_filter([{', '.join(f"CASE WHEN {r} > 0 THEN '{r}' END" for r in _RULES)}], lambda x: x IS NOT NULL), ',') AS rule_ids, {' + '.join(_RULES)} AS matches FROM c""")
def sensitive_screen(spark, d):
    return A.screen(T.files(spark, d), _RULES)


@query("path_collisions", f"{_FILES} SELECT lower(language) || '/' || CAST(byte_len AS VARCHAR) AS identity, count(DISTINCT path) AS paths, min(path) AS first_path FROM files GROUP BY 1 HAVING count(DISTINCT path) > 1")
def path_collisions(spark, d):
    return A.collisions(T.files(spark, d), F.concat_ws("/", F.lower("language"), F.col("byte_len").cast("string")))


@query("retention_newest", "SELECT event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 50")
def retention_newest(spark, d):
    return A.keep_newest(T.table(spark, d, "events").select("event_id", "event_type", "ts"), "event_id", 50, by=["event_type"])


@query("health", "SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE quality = 0) AS low, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def health(spark, d):
    joined = T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels"), "doc_id", "left")
    some = lambda c: F.count(F.when(c, 1))
    return joined.agg(F.count("*").alias("n"), some(F.col("quality").isNull()).alias("unlabelled"), some(F.col("quality") == 0).alias("low"), some(F.col("toxic") == 1).alias("toxic"))


@query("circuit_breaker", "SELECT count(*) AS files, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) >= 5 AND avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.2 AS tripped FROM events")
def circuit_breaker(spark, d):
    return A.breaker(T.table(spark, d, "events").select((F.col("event_type") == "error").alias("failed")))


@query("telemetry_summary", "SELECT event_type AS tool, count(*) AS n, count(*) FILTER (WHERE value > 5) AS slow, max(event_id) AS last_id, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type ORDER BY n DESC, tool LIMIT 10")
def telemetry_summary(spark, d):
    grouped = T.table(spark, d, "events").groupBy(F.col("event_type").alias("tool"))
    return grouped.agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 5, 1)).alias("slow"), F.max("event_id").alias("last_id"), F.round(F.avg("value"), 6).alias("mean_value")).orderBy(F.desc("n"), "tool").limit(10)


@query("session_ledger", """SELECT role AS surface, count(*) AS rows_, count(DISTINCT conv_id) AS sessions, CAST(coalesce(sum(octet_length(encode(coalesce(text, ''))) // 4), 0) AS BIGINT) AS tokens FROM conversations GROUP BY role""")
def session_ledger(spark, d):
    tokens = F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 4)
    return T.table(spark, d, "conversations").groupBy(F.col("role").alias("surface")).agg(F.count("*").alias("rows_"), F.count_distinct("conv_id").alias("sessions"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))


@query("calibration", """WITH s AS (SELECT CAST(length(text) AS DOUBLE) AS predicted, CAST(octet_length(encode(text)) AS DOUBLE) * 1.5 AS actual, doc_id % 3 = 0 AS held FROM documents WHERE length(text) > 0),
f AS (SELECT count(*) AS n, greatest(0.25, least(4.0, quantile_cont(actual / predicted, 0.5) FILTER (WHERE NOT held))) AS factor FROM s),
t AS (SELECT max(n) AS n, max(factor) AS factor, avg(abs(actual - predicted)) AS b, avg(abs(actual - predicted * factor)) AS a FROM s, f WHERE held)
SELECT n, round(factor, 6) AS factor, round(b, 6) AS mae_before, round(a, 6) AS mae_after, CASE WHEN n = 0 THEN 'deferred' WHEN n < 24 THEN 'accumulating' ELSE 'tuned' END AS state, a <= 0.8 * b AS accepted FROM t""")
def calibration(spark, d):
    docs = T.table(spark, d, "documents").where(F.length("text") > 0)
    return A.calibration(docs.select(F.length("text").cast("double").alias("predicted"), (F.octet_length("text").cast("double") * 1.5).alias("actual"), (F.col("doc_id") % 3 == 0).alias("held")))


@query("catalog_digest", f"""{_FILES}, b AS (SELECT language, md5(path)[1:3] AS bucket, count(*) AS n, sha256(string_agg(path || ':' || CAST(byte_len AS VARCHAR), chr(10) ORDER BY path)) AS digest FROM files GROUP BY ALL)
SELECT language, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY language""")
def catalog_digest(spark, d):
    return A.catalog_digest(T.files(spark, d), ["language"])


@query("conventions", f"{_FILES} SELECT language, count(*) AS n_files, CAST(sum(len(regexp_extract_all(content, '[a-z]+_[a-z]+'))) AS BIGINT) AS snake, CAST(sum(len(regexp_extract_all(content, '[A-Z][a-z]+'))) AS BIGINT) AS capital, max(byte_len) AS largest, round(avg(byte_len), 6) AS mean_bytes FROM files GROUP BY language")
def conventions(spark, d):
    hits = lambda p: F.sum(F.regexp_count("content", F.lit(p)))
    return T.files(spark, d).groupBy("language").agg(F.count("*").alias("n_files"), hits("[a-z]+_[a-z]+").alias("snake"), hits("[A-Z][a-z]+").alias("capital"), F.max("byte_len").alias("largest"), F.round(F.avg("byte_len"), 6).alias("mean_bytes"))


@query("knowledge_voice", """SELECT voice, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'unverified' WHEN toxic = 1 THEN 'withheld' WHEN quality = 1 AND n_chars > 1000 THEN 'authoritative' WHEN quality = 1 THEN 'supporting' ELSE 'historical' END AS voice FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY voice""")
def knowledge_voice(spark, d):
    joined = T.table(spark, d, "documents").select("doc_id", "n_chars").join(T.table(spark, d, "labels"), "doc_id", "left")
    voice = F.when(F.col("quality").isNull(), "unverified").when(F.col("toxic") == 1, "withheld").when((F.col("quality") == 1) & (F.col("n_chars") > 1000), "authoritative").when(F.col("quality") == 1, "supporting").otherwise("historical")
    return joined.groupBy(voice.alias("voice")).agg(F.count("*").alias("n"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 7200 THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g)
SELECT user_id, CAST(nth AS BIGINT) AS nth, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, nth""")
def session_windows(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(order))) / 1e6
    marked = T.table(spark, d, "events").withColumn("fresh", F.when(gap <= 7200, 0).otherwise(1)).withColumn("nth", F.sum("fresh").over(order))
    return marked.groupBy("user_id", "nth").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

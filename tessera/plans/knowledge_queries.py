"""Registered knowledge, evidence, excerpt and concept queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evidence as V, knowledge as K, relations as R
from tessera.plans.operations_queries import _FILES
from tessera.plans.registry import query
from tessera.plans.relation_queries import _EDGES, edges
from tessera.plans.search_queries import _LINES
from tessera.sources import tables as T


@query("knowledge_roles", """WITH c AS (SELECT doc_id % 4 AS p, doc_id % 3 AS h FROM documents),
r AS (SELECT 'decision' AS role, CASE WHEN h = 0 THEN 'heading' ELSE 'path' END AS evidence FROM c WHERE h = 0 OR p = 0 UNION ALL SELECT 'testing', CASE WHEN h = 1 THEN 'heading' ELSE 'path' END FROM c WHERE h = 1 OR p = 1 UNION ALL SELECT 'architecture', 'path' FROM c WHERE p = 1 UNION ALL SELECT 'other', 'path' FROM c WHERE h = 2 AND p > 1)
SELECT role, evidence, count(*) AS n FROM r GROUP BY ALL""")
def knowledge_roles(spark, d):
    four, three = F.col("doc_id") % 4, F.col("doc_id") % 3
    path = F.when(four == 0, "docs/ADR/0001-x.md").when(four == 1, "design/tests/a.md").otherwise("notes/b.md")
    cards = T.table(spark, d, "documents").select(path.alias("path"), F.when(three == 0, " Decisions").when(three == 1, "Security").alias("heading"))
    return K.roles(cards).groupBy("role", "evidence").agg(F.count("*").alias("n"))


_EVIDENCE = """e AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'superseded' WHEN 1 THEN 'unknown' WHEN 2 THEN 'historical' ELSE 'active' END AS lifecycle, CASE doc_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'current_implementation' WHEN 2 THEN 'unknown' WHEN 3 THEN 'historical_record' ELSE 'observed' END AS domain,
CASE WHEN toxic = 1 THEN 'deterministic_conflict' WHEN doc_id % 7 = 3 THEN 'broken_anchor' WHEN doc_id % 7 = 4 THEN 'implementation_gap' WHEN n_chars > 3000 THEN 'partial' WHEN quality IS NULL THEN 'unresolved' WHEN quality = 1 THEN 'consistent' ELSE 'not_applicable' END AS display FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT *, CASE WHEN lifecycle IN ('superseded', 'historical') THEN 'history_only' WHEN domain = 'decision' THEN 'intent' WHEN domain = 'current_implementation' AND display = 'deterministic_conflict' THEN 'suppressed' WHEN lifecycle = 'unknown' OR domain = 'unknown' OR display = 'not_applicable' THEN 'unknown' WHEN display = 'consistent' THEN 'current' ELSE 'needs_review' END AS voice FROM e)"""


def records(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars").join(T.table(spark, d, "labels"), "doc_id", "left")
    six, five, seven = F.col("doc_id") % 6, F.col("doc_id") % 5, F.col("doc_id") % 7
    flag = lambda c: F.coalesce(c, F.lit(False))
    num = lambda c: flag(c).cast("int")
    facts = docs.select(
        "doc_id",
        F.when(six == 0, "superseded").when(six == 1, "unknown").when(six == 2, "historical").otherwise("active").alias("lifecycle"),
        F.when(five == 0, "decision").when(five == 1, "current_implementation").when(five == 2, "unknown").when(five == 3, "historical_record").otherwise("observed").alias("domain"),
        num(F.col("toxic") == 1).alias("conflicts"), num(seven == 3).alias("broken"), num(seven == 4).alias("gaps"), F.lit(0).alias("suspected"), F.lit(0).alias("code_changes"), F.lit(0).alias("signals"),
        flag(F.col("n_chars") > 3000).alias("truncated"), F.col("quality").isNull().alias("unresolved"), num(F.col("quality") == 1).alias("consistent"),
    )
    shown = facts.withColumn("display", K.evidence_display())
    return shown.withColumn("voice", K.voice(F.col("lifecycle"), F.col("domain"), F.col("display")))


@query("knowledge_evidence", f"""WITH {_EVIDENCE} SELECT doc_id, display, voice, CASE WHEN lifecycle = 'superseded' AND doc_id % 4 = 0 THEN 'mark_superseded:deterministic' WHEN voice = 'current' THEN 'keep:deterministic' WHEN voice = 'intent' AND display = 'implementation_gap' THEN 'update:strong' WHEN voice = 'history_only' AND domain = 'historical_record' THEN 'archive:strong' ELSE 'needs_review:signal' END AS action FROM v""")
def knowledge_evidence(spark, d):
    successor = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id"))
    action = K.remediation(F.col("lifecycle"), F.col("domain"), F.col("voice"), F.col("display"), successor)
    return records(spark, d).select("doc_id", "display", "voice", action.alias("action"))


@query("knowledge_review", f"WITH {_EVIDENCE} SELECT 'lifecycle' AS facet, lifecycle AS value, count(*) AS n FROM v GROUP BY lifecycle UNION ALL SELECT 'domain', domain, count(*) FROM v GROUP BY domain UNION ALL SELECT 'voice', voice, count(*) FROM v GROUP BY voice UNION ALL SELECT 'all', '', count(*) FROM v")
def knowledge_review(spark, d):
    return K.review(records(spark, d))


@query("authority_records", """WITH f AS (SELECT doc_id AS path, md5(coalesce(text, '')) AS hash FROM documents), p AS (SELECT path, CASE WHEN path % 3 = 0 THEN hash ELSE 'old' END AS target_hash, path + 1 AS successor FROM f WHERE path % 2 = 0)
SELECT f.path, hash, CASE WHEN target_hash IS NULL THEN 'none' WHEN target_hash = hash THEN 'applied' ELSE 'stale' END AS policy, CASE WHEN target_hash = hash THEN 'superseded' ELSE 'unknown' END AS lifecycle, CASE WHEN target_hash = hash THEN 'decision' ELSE 'unknown' END AS domain, CASE WHEN target_hash = hash THEN successor END AS successor FROM f LEFT JOIN p USING (path)""")
def authority_records(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    policy = docs.where("path % 2 = 0").select("path", F.when(F.col("path") % 3 == 0, F.col("hash")).otherwise("old").alias("target_hash"), F.lit("superseded").alias("lifecycle"), F.lit("decision").alias("domain"), (F.col("path") + 1).alias("successor"))
    return K.authority(docs, policy)


@query("succession", """WITH RECURSIVE s AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 2 ELSE p_partkey + 1 END AS next FROM part WHERE p_partkey % 25 <> 0 OR p_partkey % 100 = 50), w(node, last, n) AS (SELECT node, next, 1 FROM s UNION ALL SELECT w.node, s.next, w.n + 1 FROM w JOIN s ON w.last = s.node WHERE w.n < 60), m AS (SELECT node, max(n) AS n, arg_max(last, n) AS last FROM w GROUP BY node)
SELECT node, CASE WHEN n < 60 THEN last END AS last, n = 60 AS cyclic FROM m""")
def succession(spark, d):
    key = F.col("p_partkey")
    parts = T.table(spark, d, "part").where("p_partkey % 25 <> 0 OR p_partkey % 100 = 50")
    return K.succession(parts.select(key.alias("node"), F.when(key % 50 == 0, key - 2).otherwise(key + 1).alias("next")))


@query("curation_preview", """SELECT 'k' || o_orderkey AS "key", CAST(o_orderkey % 2000 AS VARCHAR) AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'remove' ELSE 'upsert' END AS op,
CASE WHEN row_number() OVER (PARTITION BY o_orderkey % 2000 ORDER BY 'k' || o_orderkey) > 1 THEN 'conflict' WHEN p_partkey IS NULL AND o_orderkey % 4 = 0 THEN 'missing' WHEN CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE p_brand END IS DISTINCT FROM p_brand THEN 'stale' ELSE 'applied' END AS outcome
FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2000""")
def curation_preview(spark, d):
    parts = T.table(spark, d, "part")
    ledger = parts.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("hash"), F.col("p_name").alias("value"))
    key = F.col("o_orderkey")
    asked = T.table(spark, d, "orders").join(parts, key % 2000 == F.col("p_partkey"), "left")
    edits = asked.select(F.concat(F.lit("k"), key.cast("string")).alias("key"), (key % 2000).cast("string").alias("path"), F.when(key % 4 == 0, "remove").otherwise("upsert").alias("op"), F.when(key % 3 == 0, "x").otherwise(F.col("p_brand")).alias("expected_hash"), F.lit("new").alias("value"))
    return K.curation_preview(ledger, edits).select("key", "path", "op", "outcome")


@query("knowledge_best_hits", "SELECT p_brand AS path, p_size AS line_no, p_type AS excerpt, p_partkey AS unit FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY length(p_name), p_retailprice DESC, p_partkey) = 1")
def knowledge_best_hits(spark, d):
    hits = T.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("line_no"), F.col("p_type").alias("excerpt"), F.length("p_name").alias("unit_length"), F.col("p_retailprice").alias("heading_depth"), F.col("p_partkey").alias("unit"))
    return K.best_hits(hits).select("path", "line_no", "excerpt", "unit")


@query("excerpts", rf"""{_LINES}, a AS (SELECT path, line_no, line, length(line) AS n, instr(lower(line), 'license') - 1 AS pos FROM lines WHERE contains(lower(line), 'license')),
b AS (SELECT *, least(greatest(pos - 116, 0) + 240, n) AS e FROM a), c AS (SELECT *, greatest(e - 240, 0) AS s FROM b),
d AS (SELECT *, length(regexp_extract(line[s + 1:s + 32], '^[^\t\n\x0B\f\r ]*')) AS g, length(line[s + 1:s + 32]) AS gn, greatest(e - 32, pos + 7) AS fl FROM c),
f AS (SELECT *, CASE WHEN s > 0 AND g < gn AND s + g < pos THEN s + g + 1 ELSE s END AS lo, CASE WHEN e > fl THEN line[fl + 1:e] ELSE '' END AS tail FROM d),
h AS (SELECT *, CASE WHEN e < n AND regexp_matches(tail, '[\t\n\x0B\f\r ]') THEN fl + length(tail) - length(regexp_extract(tail, '[^\t\n\x0B\f\r ]*$')) - 1 ELSE e END AS hi FROM f)
SELECT path, line_no, CASE WHEN n <= 240 THEN line ELSE CASE WHEN lo > 0 THEN '…' ELSE '' END || line[lo + 1:hi] || CASE WHEN hi < n THEN '…' ELSE '' END END AS excerpt FROM h""")
def excerpts(spark, d):
    hits = T.lines(T.files(spark, d)).where(F.lower("line").contains("license"))
    return hits.select("path", "line_no", K.excerpt(F.col("line"), "license").alias("excerpt"))


@query("empty_reasons", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'query_too_weak' WHEN event_type = 'error' THEN 'evidence_withheld' WHEN event_type = 'signup' THEN 'evidence_noncurrent' WHEN value > 5 THEN 'no_evidence_degraded' ELSE 'no_evidence_complete' END AS reason FROM events) GROUP BY reason""")
def empty_reasons(spark, d):
    one = lambda c: c.cast("int")
    reason = K.empty_reason(F.col("event_id") % 3, one(F.col("event_id") % 2 == 0), one(F.col("event_type") == "error"), one(F.col("event_type") == "signup"), F.coalesce(F.col("value") > 5, F.lit(False)))
    return T.table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("budget_breaches", "SELECT path, count(*) FILTER (WHERE used <= 20000) AS kept, count(*) FILTER (WHERE used > 20000) AS omitted FROM (SELECT p_brand AS path, sum(CAST(p_retailprice AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS used FROM part) GROUP BY path HAVING count(*) FILTER (WHERE used > 20000) > 0")
def budget_breaches(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_brand").alias("path"), "p_partkey", F.round("p_retailprice").cast("long").alias("size"))
    return K.breaches(K.budgeted(rows, ["path"], ["p_partkey"], "size", 20_000), ["path"])


@query("concept_match", """SELECT q, CASE q WHEN 0 THEN 'error handling' WHEN 1 THEN 'error handling' WHEN 2 THEN 'cache' END AS name, CASE q WHEN 0 THEN 'exact' WHEN 1 THEN 'stemmed' WHEN 2 THEN 'stemmed' END AS match, n FROM (SELECT event_id % 4 AS q, count(*) AS n FROM events GROUP BY 1)""")
def concept_match(spark, d):
    four = F.col("event_id") % 4
    text = F.when(four == 0, "where is Error  handling done").when(four == 1, "handle the errors").when(four == 2, "Caching layers").otherwise("clinical data")
    found = K.concept(text, ["cli", "error handling", "cache", "database"])
    return T.table(spark, d, "events").select(four.alias("q"), found.alias("c")).groupBy("q", "c.name", "c.match").agg(F.count("*").alias("n"))


@query("explore_symbols", """WITH s AS (SELECT p_type AS path, p_name AS name, p_partkey AS line, regexp_matches(lower(p_name), '(^| )red( |$)') AS a, regexp_matches(lower(p_name), '(^| )bolt( |$)') AS b FROM part), f AS (SELECT 'q' AS query_id, path, name, line, CASE WHEN a AND b THEN 1.0 ELSE 0.5 END AS score FROM s WHERE a OR b)
SELECT query_id, path, name, line, CAST(score AS DOUBLE) AS score, CASE WHEN score > 0.8 THEN 'strong' ELSE 'contextual' END AS label, row_number() OVER (ORDER BY score DESC, name, path, line) AS nth FROM f ORDER BY nth LIMIT 10""")
def explore_symbols(spark, d):
    symbols = T.table(spark, d, "part").select(F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return K.explore(spark.createDataFrame([("q", "where is the Red bolts?")], "query_id string, query string"), symbols)


@query("source_scope", "SELECT event_id, event_type AS lane, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS precedence FROM events WHERE event_type IN ('view', 'click', 'error')")
def source_scope(spark, d):
    kind = F.col("event_type")
    lane = F.when(kind == "view", "current").when(kind == "click", "local_ref").when(kind == "error", "worktree").otherwise("other")
    return K.in_scope(T.table(spark, d, "events").select("event_id", kind, lane.alias("lane")), "all").select("event_id", F.col("event_type").alias("lane"), "precedence")


def _starts(*kinds: str) -> str:
    return " OR ".join(f"starts_with(t, '{x}')" for k in kinds for x in V.LINE_STARTS[k])


@query("noise_lines", f"""{_LINES}, b AS (SELECT trim(line, ' ') AS t FROM lines), k AS (SELECT NOT ({_starts("documentation", "marked")}) AND ({_starts("import", "comment")} OR t = '#' OR (starts_with(t, 'from ') AND contains(t, ' import ')) OR (regexp_matches(t, '^(const|let|var)[ \\t]') AND contains(t, 'require('))) AS noise FROM b)
SELECT noise, count(*) AS n FROM k GROUP BY noise""")
def noise_lines(spark, d):
    return T.lines(T.files(spark, d)).groupBy(V.noise_line(F.col("line")).alias("noise")).agg(F.count("*").alias("n"))


@query("output_guard", f"{_FILES} SELECT language, count(*) FILTER (WHERE w) AS withheld, count(*) FILTER (WHERE NOT w) AS shown FROM (SELECT language, regexp_matches(content, '(password|secret|token) ?[:=]') AS w FROM files) GROUP BY language")
def output_guard(spark, d):
    seen = V.guarded(T.files(spark, d).select("language", "path", "content"), ["path", "content"], "(password|secret|token) ?[:=]")
    return seen.groupBy("language").agg(F.count(F.when(F.col("withheld"), 1)).alias("withheld"), F.count(F.when(~F.col("withheld"), 1)).alias("shown"))


@query("freshness", "SELECT user_id AS source, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'degraded' WHEN count(*) FILTER (WHERE event_type = 'signup') > 0 THEN 'verifying' ELSE 'current' END AS freshness, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN string_agg(DISTINCT CASE WHEN event_type = 'error' THEN CASE WHEN value > 5 THEN 'slow' ELSE 'lost' END END, ',' ORDER BY CASE WHEN event_type = 'error' THEN CASE WHEN value > 5 THEN 'slow' ELSE 'lost' END END) ELSE '' END AS reasons FROM events GROUP BY user_id")
def freshness(spark, d):
    kind = F.col("event_type")
    checks = T.table(spark, d, "events").select(F.col("user_id").alias("source"), F.when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("ok").alias("state"), F.when(F.col("value") > 5, "slow").otherwise("lost").alias("reason"))
    return V.freshness(checks, "source")


@query("outcome_classes", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_size < 3 THEN 'invalid_request' WHEN p_size < 6 THEN 'internal_failure' WHEN p_size % 7 = 0 THEN 'empty_result' WHEN p_size % 3 = 0 THEN 'not_found' WHEN p_size % 3 = 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM part) GROUP BY outcome")
def outcome_classes(spark, d):
    s = F.col("p_size")
    return T.table(spark, d, "part").groupBy(V.outcome(s < 3, s < 6, s % 7, s % 3).alias("outcome")).agg(F.count("*").alias("n"))


@query("snapshot_spot_check", """WITH o AS (SELECT p_partkey AS path, p_retailprice AS hash, row_number() OVER (ORDER BY p_partkey, p_retailprice) AS nth, count(*) OVER () AS n FROM part), s AS (SELECT * FROM o WHERE (nth - 1) % greatest(n // greatest(CAST(ceil(n * 0.1) AS BIGINT), 1), 1) = 0)
SELECT path, CASE WHEN path % 3 = 0 THEN 'deleted' ELSE 'changed' END AS state FROM s WHERE path % 3 = 0 OR path % 4 = 0""")
def snapshot_spot_check(spark, d):
    stored = T.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("hash"))
    now = stored.where("path % 3 <> 0").withColumn("hash", F.when(F.col("path") % 4 == 0, F.col("hash") + 1).otherwise(F.col("hash")))
    return V.spot_check(stored, now, 0.1)


@query("lane_reconcile", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'removed' WHEN p_partkey % 5 = 1 THEN 'added' WHEN p_size > 25 THEN 'modified' ELSE 'same' END AS change FROM part) GROUP BY change")
def lane_reconcile(spark, d):
    lanes = T.table(spark, d, "part").select(F.col("p_partkey").alias("lane"), F.col("p_size").alias("head"))
    now = lanes.where("lane % 5 <> 0").withColumn("head", F.when(F.col("head") > 25, -1).otherwise(F.col("head")))
    return R.full_diff(lanes.where("lane % 5 <> 1"), now, ["lane"], "head").groupBy("change").agg(F.count("*").alias("n"))


@query("prompt_hints", """SELECT event_id AS prompt_id, 'file' AS kind, 'src/f' || (event_id % 50) || '.py' AS value, event_id % 7 AS line FROM events WHERE event_id % 50 < 25 UNION ALL SELECT event_id, 'symbol', event_type, NULL FROM events""")
def prompt_hints(spark, d):
    events = T.table(spark, d, "events")
    prompts = events.select(F.col("event_id").alias("prompt_id"), F.format_string("Why does %s fail in f%d.py:%d?", "event_type", F.col("event_id") % 50, F.col("event_id") % 7).alias("text"))
    prompts = prompts.withColumn("text", F.replace("text", F.lit("?"), F.lit("")))
    files = spark.range(25).select(F.format_string("src/f%d.py", "id").alias("path"))
    return V.prompt_hints(prompts, files, events.select(F.col("event_type").alias("name")).distinct())


@query("outline", """SELECT p_brand AS path, string_agg(repeat('  ', CAST(p_size % 3 AS BIGINT)) || lower(p_type) || ' ' || p_name || ' :' || p_size, chr(10) ORDER BY p_partkey) AS outline FROM part GROUP BY p_brand""")
def outline(spark, d):
    symbols = T.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("ordinal"), (F.col("p_size") % 3).alias("depth"), F.lower("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("line"))
    return V.outline(symbols)


@query("output_estimate", f"{_FILES} SELECT count(*) AS rows_, CAST(sum(byte_len) AS BIGINT) AS bytes, CAST(ceil(sum(byte_len) / 4.0) AS BIGINT) AS tokens FROM files")
def output_estimate(spark, d):
    return V.estimate(T.files(spark, d), "content")


@query("token_budget", f"{_LINES} SELECT path, count(*) AS lines_kept, max(line_no) AS last_line FROM (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_no) AS used FROM lines) WHERE used <= 800 GROUP BY path")
def token_budget(spark, d):
    return V.within_tokens(T.lines(T.files(spark, d)), 200).groupBy("path").agg(F.count("*").alias("lines_kept"), F.max("line_no").alias("last_line"))


@query("battery_gates", "SELECT CAST(sum(p_partkey - p_size) FILTER (WHERE p_size > 10) AS BIGINT) AS net, count(*) FILTER (WHERE p_size > 48) AS violations, CASE WHEN sum(p_partkey - p_size) FILTER (WHERE p_size > 10) > 0 AND count(*) FILTER (WHERE p_size > 48) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part")
def battery_gates(spark, d):
    size = F.col("p_size")
    return V.gates(T.table(spark, d, "part").select(F.col("p_partkey").alias("manual"), size.alias("served"), (size > 10).alias("accepted"), (size <= 48).alias("equivalent")))


@query("co_change_gate", f"""{_EDGES}, w AS (SELECT src, count(*) AS shared FROM edges GROUP BY src) SELECT src, CASE WHEN src % 9 <> 0 AND src % 2 = 0 AND shared >= 2 THEN CAST(shared AS DOUBLE) / 2 ELSE 0.0 END AS weight FROM w""")
def co_change_gate(spark, d):
    shared = edges(spark, d).groupBy("src").agg(F.count("*").alias("shared"))
    anchor = F.when(F.col("src") % 9 == 0, "a/yarn.lock").otherwise("a/b.py")
    return shared.select("src", V.co_change_gate(anchor, F.when(F.col("src") % 2 == 0, 0.8).otherwise(0.4), F.col("shared"), F.col("shared") / 2).alias("weight"))


@query("impact_sources", "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' OR l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size = 1")
def impact_sources(spark, d):
    items = T.table(spark, d, "lineitem")
    some = lambda c: items.where(c).select(F.col("l_partkey").alias("path"))
    untracked = T.table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("path"))
    return some("l_shipdate >= TIMESTAMP '2001-06-01'").union(some("l_returnflag = 'R'")).union(untracked).distinct()

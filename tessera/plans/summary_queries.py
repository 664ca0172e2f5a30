"""Reports and merges over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import summaries as U
from tessera.plans.registry import query
from tessera.sources import tables as T


@query("key_types_ranked", """WITH t AS (SELECT DISTINCT p_brand AS path, p_name AS name, lower(p_type) AS kind FROM part), r AS (SELECT DISTINCT p.p_brand AS path, q.p_name AS name FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber JOIN part p ON a.l_partkey = p.p_partkey JOIN part q ON b.l_partkey = q.p_partkey),
c AS (SELECT p_brand AS path, count(*) AS churn FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT t.path, t.name, t.kind, count(*) FILTER (WHERE r.path <> t.path) AS dependents FROM t LEFT JOIN r ON r.name = t.name GROUP BY ALL)
SELECT s.path, s.name, s.kind, dependents, coalesce(churn, 0) AS churn, CASE WHEN dependents >= 2 THEN '→' || dependents END AS label FROM s LEFT JOIN c USING (path) ORDER BY dependents DESC, churn DESC, path, name, kind LIMIT 15""")
def key_types_ranked(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"))
    items = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    used = items.join(after, ["l_orderkey", "l_linenumber"]).join(parts.select(F.col("p_partkey").alias("l_partkey"), "path"), "l_partkey").join(parts.select(F.col("p_partkey").alias("next"), "name"), "next")
    churn = items.join(parts.select(F.col("p_partkey").alias("l_partkey"), "path"), "l_partkey").groupBy("path").agg(F.count("*").alias("churn"))
    return U.key_types(parts.select("path", "name", "kind").distinct(), used.select("path", "name"), churn)


@query("health_facts", """WITH f AS (SELECT CASE WHEN text IS NULL THEN 'failed' WHEN n_chars % 3 = 0 THEN 'partial' ELSE 'processed' END AS status, n_chars AS n_symbols, CASE WHEN n_chars > 5000 THEN 'too_large' ELSE 'normal' END AS tier, doc_id % 11 = 0 AS vendor, doc_id % 7 = 0 AS generated, doc_id % 5 = 0 AS test, contains(text, '{{') OR doc_id % 3 = 0 AS template FROM documents)
SELECT 'status' AS fact, status AS value, count(*) AS n FROM f GROUP BY status UNION ALL SELECT 'tier', tier, count(*) FROM f GROUP BY tier UNION ALL SELECT 'symbols', 'total', CAST(sum(n_symbols) AS BIGINT) FROM f
UNION ALL SELECT 'partial', CASE WHEN vendor THEN 'vendor' WHEN generated THEN 'generated' WHEN test THEN 'test_fixture' WHEN template THEN 'template_dsl' ELSE 'unexpected' END AS b, count(*) FROM f WHERE status = 'partial' GROUP BY b""")
def health_facts(spark, d):
    docs, n = T.table(spark, d, "documents"), F.col("doc_id")
    status = F.when(F.col("text").isNull(), "failed").when(F.col("n_chars") % 3 == 0, "partial").otherwise("processed")
    tier = F.when(F.col("n_chars") > 5000, "too_large").otherwise("normal")
    return U.health(docs.select(n.cast("string").alias("path"), status.alias("status"), F.col("n_chars").alias("n_symbols"), tier.alias("tier"), (n % 11 == 0).alias("vendor"), (n % 7 == 0).alias("generated"), (n % 5 == 0).alias("test"), (F.col("text").contains("{{") | (n % 3 == 0)).alias("template")))


@query("telemetry_facts", """WITH c AS (SELECT event_id AS id, event_type AS tool, CAST(CAST(floor(value) AS BIGINT) % 17 AS VARCHAR) AS outcome, value > 5 AS success FROM events)
SELECT 'total' AS fact, NULL AS value, count(*) AS n FROM c UNION ALL SELECT 'success', NULL, count(*) FROM c WHERE success UNION ALL SELECT 'failure', NULL, count(*) FROM c WHERE NOT success UNION ALL SELECT 'last_id', NULL, max(id) FROM c
UNION ALL (SELECT 'tool', tool, count(*) AS n FROM c GROUP BY tool ORDER BY n DESC, tool LIMIT 10) UNION ALL (SELECT 'outcome', outcome, count(*) AS n FROM c GROUP BY outcome ORDER BY n DESC, outcome LIMIT 10)""")
def telemetry_facts(spark, d):
    events = T.table(spark, d, "events")
    return U.telemetry(events.select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), (F.floor("value") % 17).cast("string").alias("outcome"), (F.col("value") > 5).alias("success")))


@query("ledger_facts", "SELECT count(*) AS events, CAST(coalesce(sum(CAST(floor(value * 100) AS BIGINT) - 500), 0) AS BIGINT) AS net, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(DISTINCT user_id) AS sessions FROM events")
def ledger_facts(spark, d):
    return U.ledger(T.table(spark, d, "events").select((F.floor(F.col("value") * 100) - 500).alias("net"), (F.col("event_type") == "purchase").alias("accepted"), F.col("user_id").alias("session")))


@query("import_roots", """WITH i AS (SELECT lower(string_split(p_type || '::' || p_brand, '::')[1]) AS root FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT root, count(*) AS n FROM i WHERE strlen(root) > 1 GROUP BY root),
m AS (SELECT DISTINCT lower(replace(n_name, '-', '_')) AS root FROM nation WHERE strlen(n_name) > 1 AND NOT contains(n_name, '.') UNION SELECT DISTINCT lower(p_type) FROM part WHERE NOT contains(p_type, '.'))
SELECT * FROM (SELECT * FROM u UNION ALL SELECT root, 1 FROM m WHERE root NOT IN (SELECT root FROM u)) ORDER BY n DESC, root LIMIT 20""")
def import_roots(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    used = T.table(spark, d, "lineitem").select("l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("::", "p_type", "p_brand").alias("name"))
    told = T.table(spark, d, "nation").select(F.lit("a/Cargo.toml").alias("path"), F.concat(F.lit("dependencies."), "n_name").alias("key")).unionByName(parts.select(F.lit("package.json").alias("path"), F.concat(F.lit("devDependencies."), "p_type").alias("key")))
    return U.import_roots(used, told, top=20)


@query("changed_since", """WITH f AS (SELECT o_custkey AS path, max(o_orderdate) AS ts FROM orders GROUP BY 1), h AS (SELECT CAST(path AS VARCHAR) AS path FROM f WHERE ts >= TIMESTAMP '2000-01-01'), n AS (SELECT path, row_number() OVER (ORDER BY path) AS nth, count(*) OVER () AS total FROM h)
SELECT nth, path, total, greatest(total - 200, 0) AS overflow FROM n WHERE nth <= 200""")
def changed_since(spark, d):
    files = T.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.max("o_orderdate").alias("ts"))
    return U.changed_since(files, F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("1990-01-01").cast("timestamp_ntz"))


@query("newest_window", "SELECT o_orderkey AS oid, o_orderdate AS ts FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' ORDER BY ts DESC, oid LIMIT 300")
def newest_window(spark, d):
    return U.newest_window(T.commits(spark, d).select("oid", "ts"), 300, since=F.lit("1999-01-01").cast("timestamp_ntz"))


@query("projects_selected", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY source")
def projects_selected(spark, d):
    rows = T.table(spark, d, "documents").select(F.col("source").alias("project"))
    return U.of_projects(rows, active="src0", projects=["src1", "src3"]).groupBy(F.col("project").alias("source")).agg(F.count("*").alias("n"))


@query("commitments", """SELECT user_id AS call, json_extract_string(props, '$.k') AS path, max(ts) AS ts FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL""")
def commitments(spark, d):
    events = T.table(spark, d, "events").select(F.col("user_id").alias("call"), F.get_json_object("props", "$.k").alias("path"), F.col("event_type").alias("kind"), "ts")
    return U.commitments(events, kinds=("click", "purchase"))


@query("additive_merge", """WITH t AS (SELECT l_partkey AS k, count(*) AS n, max(l_shipdate) AS last FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), r AS (SELECT l_partkey AS k, count(*) AS n, max(l_shipdate) AS last FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
SELECT k, coalesce(t.n, 0) + coalesce(r.n, 0) AS n, coalesce(r.last, t.last) AS last FROM t FULL JOIN r USING (k)""")
def additive_merge(spark, d):
    items = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_shipdate")
    table = items.where("l_orderkey % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    rows = items.where("l_orderkey % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    return U.merged(table, rows, ["k"], mode="add", add=("n",))


@query("batch_edit_preview", """WITH e AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN n < 30 THEN 'out_of_range' WHEN doc_id % 5 = 0 THEN 'overlap' ELSE 'applied' END AS state, 3 AS n_edits, CASE WHEN n >= 30 AND doc_id % 5 <> 0 THEN sha256('<' || substr(text, 1, 10) || doc_id || substr(text, 21, 10) || '>' || substr(text, 31)) END AS digest FROM e""")
def batch_edit_preview(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    put = lambda a, b, text: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), text.alias("text"))
    last = F.when(F.col("doc_id") % 5 == 0, F.lit(15)).otherwise(F.lit(30))
    edits = docs.select("path", F.explode(F.array(put(F.lit(0), F.lit(0), F.lit("<")), put(F.lit(10), F.lit(20), F.col("doc_id").cast("string")), put(last, F.lit(30), F.lit(">")))).alias("e")).select("path", "e.*")
    return U.edited(docs, edits).select("path", "state", "n_edits", F.sha2("content", 256).alias("digest"))

"""Registered views, exports and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extraction as E, relations as R, search as S, views as V
from tessera.plans.history_queries import _LOG, log
from tessera.plans.operations_queries import _FILES
from tessera.plans.registry import query
from tessera.plans.relation_queries import _EDGES, edges
from tessera.plans.search_queries import _LINES
from tessera.sources import tables as T


@query("glob_search", f"{_FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]*/(?:en|de)/[^/]*7$')")
def glob_search(spark, d):
    return T.files(spark, d).where(F.col("path").rlike(V.glob_regex("src1*/{en,de}/*7"))).select("path")


@query("path_tree_rollup", """SELECT dir, count(*) AS n_files, CAST(sum(byte_len) AS BIGINT) AS bytes FROM (SELECT unnest([source, source || '/' || lang]) AS dir, octet_length(encode(coalesce(text, ''))) AS byte_len FROM documents) GROUP BY dir""")
def path_tree_rollup(spark, d):
    return V.prefixes(T.files(spark, d))


@query("text_search_grouped", f"{_LINES} SELECT string_split(path, '/')[1] AS source, count(*) AS hits, count(DISTINCT path) AS files FROM lines WHERE contains(lower(line), 'the') GROUP BY 1")
def text_search_grouped(spark, d):
    hits = T.lines(T.files(spark, d)).where(S.literal("the"))
    return hits.groupBy(F.split("path", "/")[0].alias("source")).agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))


@query("result_compaction", f"""{_LINES}, s AS (SELECT path, line_no, contains(line, 'token') AS error, CASE WHEN contains(line, 'token') THEN 5 ELSE 0 END + CASE WHEN contains(lower(line), 'license') THEN 3 ELSE 0 END AS points FROM lines),
b AS (SELECT path FROM s WHERE points > 0 GROUP BY path ORDER BY sum(points) DESC, path LIMIT 20),
n AS (SELECT s.*, row_number() OVER (PARTITION BY path, error ORDER BY points DESC, line_no) AS nth FROM s WHERE points > 0 AND path IN (SELECT path FROM b))
SELECT path, line_no, CAST(points AS BIGINT) AS points FROM n WHERE error OR nth <= 10""")
def result_compaction(spark, d):
    return V.compact(T.lines(T.files(spark, d)), F.col("line").contains("token"), F.lower("line").contains("license"))


@query("fair_interleave", "SELECT p_partkey, lane, turn FROM (SELECT p_partkey, p_size > 25 AS lane, row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part) ORDER BY turn, lane LIMIT 40")
def fair_interleave(spark, d):
    rows = T.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return V.interleave(rows, F.col("p_size") > 25, [F.desc("p_retailprice"), F.col("p_partkey")]).orderBy("turn", "lane").limit(40).select("p_partkey", "lane", "turn")


@query("nearest_match", """WITH RECURSIVE o AS (SELECT p_name AS name, p_type AS kind, list(p_partkey ORDER BY p_partkey) AS olds FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL),
n AS (SELECT p_name AS name, p_type AS kind, list(p_partkey + 3 ORDER BY p_partkey) AS news FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL),
g AS (SELECT name, kind, coalesce(olds, []) AS olds, coalesce(news, []) AS news FROM o FULL OUTER JOIN n USING (name, kind)),
w AS (SELECT name, kind, olds, news, 0 AS i, NULL::BIGINT AS old_line FROM g
UNION ALL SELECT name, kind, list_filter(olds, lambda x: pick IS NULL OR x <> pick), news, i + 1, pick FROM (SELECT *, list_sort(list_transform(olds, lambda x: [abs(x - news[i + 1]), x]))[1][2] AS pick FROM w WHERE i < len(news)))
SELECT name, kind, old_line, news[i] AS new_line FROM w WHERE i > 0 UNION ALL SELECT name, kind, unnest(olds), NULL FROM w WHERE i = len(news)""")
def nearest_match(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("line"))
    return V.nearest_matches(parts.where("line % 7 <> 0"), parts.where("line % 5 <> 0").withColumn("line", F.col("line") + 3), ["name", "kind"])


@query("recency_store", """SELECT lane, handle, bytes, at_, used, nth FROM (SELECT event_type AS lane, event_id AS handle, CAST(floor(value * 100) AS BIGINT) AS bytes, ts AS at_, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS used, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE nth <= 256 AND used <= 100000""")
def recency_store(spark, d):
    blobs = T.table(spark, d, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("handle"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), F.col("ts").alias("at"))
    return V.recency_store(blobs, entries=256, size=100_000).withColumnRenamed("at", "at_")


@query("diagnostics_page", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'signup') ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, value DESC, event_id LIMIT 30 OFFSET 60")
def diagnostics_page(spark, d):
    rows = T.table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type", "value")
    return V.page(rows, [F.when(F.col("event_type") == "error", 0).otherwise(1), F.desc("value"), F.col("event_id")], offset=60, limit=30)


@query("graph_export_dot", f"""{_EDGES}, s AS (SELECT src, dst FROM edges ORDER BY src, dst LIMIT 200) SELECT 'digraph {{' || chr(10) || string_agg('  "' || src || '" -> "' || dst || '";', chr(10) ORDER BY src, dst) || chr(10) || '}}' AS text FROM s""")
def graph_export_dot(spark, d):
    return V.dot(edges(spark, d))


@query("graph_export_mermaid", f"""{_EDGES}, s AS (SELECT src, dst FROM edges ORDER BY src, dst LIMIT 200) SELECT 'graph LR' || chr(10) || string_agg('  n' || src || ' --> n' || dst, chr(10) ORDER BY src, dst) AS text FROM s""")
def graph_export_mermaid(spark, d):
    return V.mermaid(edges(spark, d))


@query("impact_summary", f"""{_EDGES}, reach(node, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 11 UNION SELECT e.src, r.hop + 1 FROM reach r JOIN edges e ON e.dst = r.node WHERE r.hop < 2), best AS (SELECT node, min(hop) AS hop FROM reach GROUP BY node)
SELECT CASE WHEN hop = 1 AND p_size > 45 THEN 'critical' WHEN hop = 1 THEN 'high' ELSE 'medium' END AS risk, count(*) AS n FROM best JOIN part ON node = p_partkey WHERE hop > 0 GROUP BY 1""")
def impact_summary(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size")
    found = R.reach(edges(spark, d), parts.where("node % 100 = 11"), 2).join(parts, "node")
    return found.groupBy(R.risk(F.col("hop"), F.col("p_size") > 45).alias("risk")).agg(F.count("*").alias("n"))


@query("key_types", "SELECT p_type AS name, count(DISTINCT l_orderkey) AS dependents, count(*) AS refs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type ORDER BY dependents DESC, name LIMIT 15")
def key_types(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("name"))
    refs = T.table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return refs.groupBy("name").agg(F.count_distinct("l_orderkey").alias("dependents"), F.count("*").alias("refs")).orderBy(F.desc("dependents"), "name").limit(15)


@query("what_changed", f"{_LOG} SELECT DISTINCT path FROM log WHERE ts >= TIMESTAMP '2001-07-25' ORDER BY path LIMIT 200")
def what_changed(spark, d):
    return log(spark, d).where("ts >= TIMESTAMP '2001-07-25'").select("path").distinct().orderBy("path").limit(200)


@query("page_links", """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""")
def page_links(spark, d):
    links = T.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("link_roots", """SELECT root, count(*) AS n FROM (SELECT split_part(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', 1) AS root FROM pages) GROUP BY root ORDER BY n DESC, root LIMIT 10""")
def link_roots(spark, d):
    root = F.split_part(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit("."), F.lit(1))
    return T.table(spark, d, "pages").groupBy(root.alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(10)


@query("coverage_status", """SELECT source, count(*) AS docs, count(quality) AS labelled, CASE max(CASE WHEN quality IS NULL THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'degraded' WHEN 1 THEN 'verifying' ELSE 'complete' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_status(spark, d):
    joined = T.table(spark, d, "documents").select("doc_id", "source").join(T.table(spark, d, "labels"), "doc_id", "left")
    worst = F.max(F.when(F.col("quality").isNull(), 2).when(F.col("toxic") == 1, 1).otherwise(0))
    return joined.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.when(worst == 2, "degraded").when(worst == 1, "verifying").otherwise("complete").alias("status"))


@query("window_difference", "SELECT 'incoming' AS side, o_orderkey AS oid FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' UNION ALL SELECT 'outgoing', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01'")
def window_difference(spark, d):
    commits = T.commits(spark, d).select("oid", "ts")
    old, new = commits.where("ts < TIMESTAMP '2001-07-01'"), commits.where("ts >= TIMESTAMP '1995-02-01'")
    side = lambda a, b, name: a.join(b.select("oid"), "oid", "left_anti").select(F.lit(name).alias("side"), "oid")
    return side(new, old, "incoming").unionByName(side(old, new, "outgoing"))


@query("trace_symbol", """WITH s AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey = 111)
SELECT 'sibling' AS section, CAST(p.p_partkey AS VARCHAR) AS item FROM part p, s WHERE p.p_brand = s.p_brand AND p.p_type = s.p_type AND p.p_partkey <> s.p_partkey
UNION ALL SELECT 'same_name', CAST(p.p_partkey AS VARCHAR) FROM part p, s WHERE p.p_name = s.p_name AND p.p_partkey <> s.p_partkey
UNION ALL SELECT 'dependent', CAST(l_orderkey AS VARCHAR) FROM lineitem, s WHERE l_partkey = s.p_partkey GROUP BY l_orderkey""")
def trace_symbol(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    own = F.broadcast(parts.where("p_partkey = 111").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("t")))  # one symbol
    part = lambda rows, section, col: rows.select(F.lit(section).alias("section"), F.col(col).cast("string").alias("item"))
    siblings = parts.join(own, (F.col("p_brand") == F.col("b")) & (F.col("p_type") == F.col("t"))).where("p_partkey <> k")
    named = parts.join(own, F.col("p_name") == F.col("n")).where("p_partkey <> k")
    users = T.table(spark, d, "lineitem").where("l_partkey = 111").select("l_orderkey").distinct()
    return part(siblings, "sibling", "p_partkey").unionByName(part(named, "same_name", "p_partkey")).unionByName(part(users, "dependent", "l_orderkey"))


@query("ask_routes", r"""SELECT route, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(q), '\b(who calls|callers|references|used by|usages)\b') THEN 'references' WHEN regexp_matches(lower(q), '\b(impact|break|blast|affected)\b') THEN 'impact' WHEN regexp_matches(lower(q), '\b(changed|churn|history|commit|owner)\b') THEN 'history' WHEN regexp_matches(lower(q), '\b(function|class|method|symbol|defined)\b') THEN 'symbols' WHEN regexp_matches(lower(q), '\b(file|path|folder|directory)\b') THEN 'files' ELSE 'text' END AS route
FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'Who calls ' WHEN 1 THEN 'what changed in ' WHEN 2 THEN 'find path ' WHEN 3 THEN 'blast radius of ' ELSE 'show ' END || event_type AS q FROM events)) GROUP BY route""")
def ask_routes(spark, d):
    kind = F.col("event_id") % 5
    text = F.concat(F.when(kind == 0, "Who calls ").when(kind == 1, "what changed in ").when(kind == 2, "find path ").when(kind == 3, "blast radius of ").otherwise("show "), "event_type")
    return T.table(spark, d, "events").groupBy(V.route(text).alias("route")).agg(F.count("*").alias("n"))


@query("config_flatten", "SELECT CAST(event_id AS VARCHAR) AS id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def config_flatten(spark, d):
    return E.json_keys(T.table(spark, d, "events"), "event_id", "props")

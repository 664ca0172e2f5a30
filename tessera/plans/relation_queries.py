"""Registered reference, graph, overlay and diff queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relations as R
from tessera.plans.registry import query
from tessera.sources import tables as T

#: A graph of parts: an order's parts in line order call one another.
_EDGES = """WITH RECURSIVE edges AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber WHERE x.l_partkey <> y.l_partkey)"""


def edges(spark, d):
    items = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return R.call_edges(items.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst"))


@query("call_graph", f"{_EDGES} SELECT src, dst FROM edges")
def call_graph(spark, d):
    return edges(spark, d)


@query("top_in_degree", f"{_EDGES} SELECT dst AS node, count(*) AS callers FROM edges GROUP BY dst ORDER BY callers DESC, node LIMIT 20")
def top_in_degree(spark, d):
    return edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "node").limit(20)


@query("blast_radius", f"""{_EDGES}, reach(node, hop) AS (SELECT DISTINCT p_partkey, 0 FROM part WHERE p_partkey % 100 = 11 UNION SELECT e.src, r.hop + 1 FROM reach r JOIN edges e ON e.dst = r.node WHERE r.hop < 3),
best AS (SELECT node, min(hop) AS hop FROM reach GROUP BY node)
SELECT node, CAST(hop AS BIGINT) AS hop, CASE WHEN hop = 1 AND p_size > 45 THEN 'critical' WHEN hop = 1 THEN 'high' WHEN hop = 2 THEN 'medium' ELSE 'low' END AS risk FROM best JOIN part ON node = p_partkey WHERE hop > 0""")
def blast_radius(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size")
    found = R.reach(edges(spark, d), parts.where(F.col("node") % 100 == 11), 3)
    return found.join(parts, "node").select("node", "hop", R.risk(F.col("hop"), F.col("p_size") > 45).alias("risk"))


@query("blast_radius_bounded", f"""{_EDGES}, reach(node, hop) AS (SELECT DISTINCT p_partkey, 0 FROM part WHERE p_partkey % 100 = 11 UNION SELECT e.src, r.hop + 1 FROM reach r JOIN edges e ON e.dst = r.node WHERE r.hop < 3),
best AS (SELECT node, min(hop) AS hop FROM reach GROUP BY node), deg AS (SELECT x.node, x.hop, count(*) AS n FROM best x JOIN edges e ON e.src = x.node JOIN best y ON e.dst = y.node AND y.hop = x.hop - 1 WHERE x.hop > 0 GROUP BY ALL)
SELECT node, CAST(hop AS BIGINT) AS hop, (SELECT count(*) FROM deg) > 1000 AS truncated FROM deg ORDER BY hop, n DESC, node LIMIT 1000""")
def blast_radius_bounded(spark, d):
    seeds = T.table(spark, d, "part").select(F.col("p_partkey").alias("node")).where("node % 100 = 11")
    found = R.bounded_reach(edges(spark, d), seeds, 3, 1000)
    return found.nodes.withColumn("truncated", F.lit(found.truncated))


@query("resolve_unique", """SELECT s_suppkey AS call, name, node FROM (SELECT s_suppkey, lower(n_name) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey) c
JOIN (SELECT lower(n_name) AS name, min(n_nationkey) AS node, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) = 1) USING (name)""")
def resolve_unique(spark, d):
    nation = T.table(spark, d, "nation")
    calls = T.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("call"), F.lower("n_name").alias("name"))
    return R.resolve_unique(calls, nation.select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("node"))).select("call", "name", "node")


@query("references_by_name", "SELECT p_name AS name, count(*) AS refs, count(DISTINCT l_orderkey) AS places FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name")
def references_by_name(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    refs = T.table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return refs.groupBy("name").agg(F.count("*").alias("refs"), F.count_distinct("l_orderkey").alias("places"))


@query("innermost_symbol", """WITH p AS (SELECT p_brand AS path, p_partkey AS pos FROM part), r AS (SELECT p_brand AS path, p_partkey AS "start", p_partkey + p_size * 4 AS "end", p_name AS name FROM part),
j AS (SELECT p.path, p.pos, r."start", r."end", r.name, row_number() OVER (PARTITION BY p.path, p.pos ORDER BY r."start" DESC, r.name) AS nth FROM p LEFT JOIN r ON p.path = r.path AND p.pos > r."start" AND p.pos <= r."end")
SELECT path, pos, "start", "end", name FROM j WHERE nth = 1""")
def innermost_symbol(spark, d):
    parts = T.table(spark, d, "part")
    points = parts.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos"))
    ranges = parts.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") * 4).alias("end"), F.col("p_name").alias("name"))
    return R.innermost(points, ranges.withColumn("start", F.col("start") + 1), ["path"], "pos", [F.desc("start"), F.col("name")]).withColumn("start", F.col("start") - 1)


_VERSIONS = """old AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 4 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 5)"""


def versions(spark, d):
    orders = T.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 10 == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.where("o_orderkey % 10 <> 3"), orders.where("o_orderkey % 10 <> 5").withColumn("o_totalprice", changed)


@query("version_diff", f"""WITH {_VERSIONS} SELECT o_orderkey, old.o_totalprice AS "old", new.o_totalprice AS "new", CASE WHEN old.o_orderkey IS NULL THEN 'added' WHEN new.o_orderkey IS NULL THEN 'removed' WHEN old.o_totalprice = new.o_totalprice THEN 'same' ELSE 'modified' END AS change FROM old FULL OUTER JOIN new USING (o_orderkey)""")
def version_diff(spark, d):
    return R.full_diff(*versions(spark, d), ["o_orderkey"], "o_totalprice")


@query("overlay_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 4 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 5")
def overlay_merge(spark, d):
    old, new = versions(spark, d)
    upserts = new.where("o_orderkey % 10 IN (3, 4)")
    return R.overlay(old, upserts, old.where("o_orderkey % 10 = 5").select("o_orderkey"), "o_orderkey")


@query("evict_dead", """SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber
WHERE x.l_partkey <> y.l_partkey AND x.l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 30) AND y.l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 30)""")
def evict_dead(spark, d):
    live = T.table(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("path"))
    return R.evict(edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")), live)


@query("link_resolution", """WITH c AS (SELECT page_id AS unit, unnest(list_distinct(list_transform(regexp_extract_all(html, '<a href="/([^"/?#]*)"', 1), lambda x: lower(x)))) AS target FROM pages),
t AS (SELECT lower(regexp_extract(url, '([^/?#]+)[^/]*$', 1)) AS name, url AS path FROM pages UNION SELECT lower(p_name), p_brand FROM part UNION SELECT lang, source FROM documents UNION SELECT 'the', lang FROM documents),
n AS (SELECT name, count(*) AS n, list_sort(list(path)) AS paths FROM t GROUP BY name)
SELECT unit, target, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS state, coalesce(n, 0) AS n, coalesce(array_to_string(paths[1:8], ','), '') AS paths FROM c LEFT JOIN n ON target = name""")
def link_resolution(spark, d):
    pages = T.table(spark, d, "pages")
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"/?#]*)"'), F.lit(1)), F.lower))
    candidates = pages.select(F.col("page_id").alias("unit"), F.explode(targets).alias("target"))
    docs = T.table(spark, d, "documents")
    named = pages.select(F.lower(F.regexp_extract("url", "([^/?#]+)[^/]*$", 1)).alias("name"), F.col("url").alias("path"))
    named = named.unionByName(T.table(spark, d, "part").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("path"))).unionByName(docs.select(F.col("lang").alias("name"), F.col("source").alias("path"))).unionByName(docs.select(F.lit("the").alias("name"), F.col("lang").alias("path")))
    return R.links(candidates, named)


@query("cross_project", """SELECT project_id, count(*) AS n, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM (SELECT 'docs' AS project_id, coalesce(text, '') AS content FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY project_id""")
def cross_project(spark, d):
    parts = [T.table(spark, d, t).select(F.lit(p).alias("project_id"), F.coalesce(F.col(c), F.lit("")).alias("content")) for p, t, c in (("docs", "documents", "text"), ("pages", "pages", "html"), ("benchmark", "benchmark", "text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("project_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query("definition_sites", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = l_linenumber)")
def definition_sites(spark, d):
    references = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    definitions = T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("l_linenumber"))
    return R.without_definitions(references, definitions, ["l_partkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber")

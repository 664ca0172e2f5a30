"""Registered inspection, grouped search, lookup and edit preview queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import inspection as I, search as S
from tessera.plans.operations_queries import _FILES
from tessera.plans.registry import query
from tessera.plans.search_queries import _LINES
from tessera.sources import tables as T

_PLACES = """sym AS (SELECT p_brand AS path, p_name || p_partkey AS name, p_size % 4 AS depth, p_partkey AS "start", p_partkey + p_size * 3 AS "end" FROM part), pt AS (SELECT DISTINCT p_brand AS path, p_partkey + 5 AS line_no FROM part)"""


def symbols(spark, d):
    key = F.col("p_partkey")
    return T.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.concat("p_name", key.cast("string")).alias("name"), (F.col("p_size") % 4).alias("depth"), key.alias("start"), (key + F.col("p_size") * 3).alias("end"))


def points(spark, d):
    return T.table(spark, d, "part").select(F.col("p_brand").alias("path"), (F.col("p_partkey") + 5).alias("line_no"))


@query("enclosing_symbol", f"""WITH {_PLACES} SELECT pt.path, pt.line_no, s.name AS symbol, s.depth AS symbol_depth FROM pt LEFT JOIN sym s ON s.path = pt.path AND pt.line_no BETWEEN s."start" AND s."end" QUALIFY row_number() OVER (PARTITION BY pt.path, pt.line_no ORDER BY s.depth DESC, s."start" DESC, s.name DESC) = 1""")
def enclosing_symbol(spark, d):
    return I.enclosing(points(spark, d).distinct(), symbols(spark, d))


@query("hits_by_symbol", f"""WITH {_PLACES}, e AS (SELECT pt.path, pt.line_no, s.name AS symbol FROM pt JOIN sym s ON s.path = pt.path AND pt.line_no BETWEEN s."start" AND s."end" QUALIFY row_number() OVER (PARTITION BY pt.path, pt.line_no ORDER BY s.depth DESC, s."start" DESC, s.name DESC) = 1)
SELECT path, symbol, count(*) AS hits, min(line_no) AS first_line FROM e GROUP BY path, symbol""")
def hits_by_symbol(spark, d):
    return I.grouped_hits(points(spark, d).distinct(), symbols(spark, d), "symbol")


@query("follow_references", """WITH g AS (SELECT p_brand AS path, p_partkey AS symbol, p_size AS hits FROM part), b AS (SELECT path FROM g GROUP BY path ORDER BY sum(hits) DESC, path LIMIT 3), k AS (SELECT path, symbol, 'o' || l_orderkey AS caller, row_number() OVER (PARTITION BY path, symbol ORDER BY 'o' || l_orderkey) AS nth FROM g JOIN b USING (path) LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = symbol)
SELECT path, symbol, coalesce(string_agg(caller, ',' ORDER BY caller), '') AS callers FROM k WHERE nth <= 5 GROUP BY path, symbol""")
def follow_references(spark, d):
    groups = T.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("symbol"), F.col("p_size").alias("hits"))
    return I.follow(groups, T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path")))


@query("inspect_match", f"""WITH {_PLACES}, i AS (SELECT pt.path, pt.line_no, s.name, s.depth, s."start" AS st FROM pt JOIN sym s ON s.path = pt.path AND pt.line_no BETWEEN s."start" AND s."end" QUALIFY row_number() OVER (PARTITION BY pt.path, pt.line_no, s.depth ORDER BY s."end" - s."start", s."start", s.name) = 1),
c AS (SELECT path, line_no, string_agg(name, ' > ' ORDER BY depth) AS parents, max(depth) AS depth, arg_max(name, depth) AS own FROM i GROUP BY path, line_no), o AS (SELECT c.path, c.line_no, s.name, row_number() OVER (PARTITION BY c.path, c.line_no ORDER BY s."start", s.name) AS nth, count(*) OVER (PARTITION BY c.path, c.line_no) AS n FROM c JOIN sym s ON s.path = c.path AND s.depth = c.depth AND s.name <> c.own),
l AS (SELECT path, line_no, string_agg(name, ',' ORDER BY nth) FILTER (WHERE nth <= 10) AS siblings, greatest(max(n) - 10, 0) AS overflow FROM o GROUP BY path, line_no)
SELECT pt.path, pt.line_no, parents, CASE WHEN parents IS NOT NULL THEN coalesce(siblings, '') END AS siblings, CASE WHEN parents IS NOT NULL THEN coalesce(overflow, 0) END AS overflow FROM pt LEFT JOIN c ON pt.path = c.path AND pt.line_no = c.line_no LEFT JOIN l ON pt.path = l.path AND pt.line_no = l.line_no""")
def inspect_match(spark, d):
    return I.inspect(points(spark, d), symbols(spark, d))


@query("lookup_basename", f"{_FILES} SELECT path FROM files WHERE string_split(path, '/')[-1] IN ('17', '170')")
def lookup_basename(spark, d):
    return I.by_basename(T.files(spark, d), ["17", "170"])


@query("lookup_component", f"{_FILES} SELECT path FROM files WHERE language = 'de'")
def lookup_component(spark, d):
    return I.by_component(T.files(spark, d), "DE")


@query("trigram_update", f"{_FILES}, u AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'new text ' || doc_id ELSE language || source END AS text FROM files WHERE doc_id % 10 <> 2) SELECT gram, count(*) AS n FROM (SELECT DISTINCT id, lower(text)[i:i + 2] AS gram FROM u, range(1, 200) r(i) WHERE i <= length(text) - 2) GROUP BY gram")
def trigram_update(spark, d):
    units = T.files(spark, d).select(F.col("doc_id").alias("id"), F.concat("language", "source").alias("text"))
    grams = units.select(F.explode(S.trigrams(F.col("text"))).alias("gram"), "id")
    changed = units.where("id % 10 = 1").withColumn("text", F.concat(F.lit("new text "), F.col("id").cast("string")))
    return I.update_grams(grams, changed, units.where("id % 10 = 2")).groupBy("gram").agg(F.count("*").alias("n"))


@query("trigram_update_texts")
def trigram_update_texts(spark, d):
    units = T.files(spark, d).select(F.col("doc_id").alias("id"), F.col("content").alias("text"))
    grams = units.select(F.explode(S.trigrams(F.col("text"))).alias("gram"), "id")
    changed = units.where("id % 10 = 1").withColumn("text", F.concat(F.lit("new text "), "text"))
    return I.update_grams(grams, changed, units.where("id % 10 = 2")).groupBy("gram").agg(F.count("*").alias("n"))


@query("rename_preview", rf"""{_LINES} SELECT path, line_no, len(regexp_extract_all(line, '\btoken\b')) AS sites, regexp_replace(line, '\btoken\b', 'mark', 'g') AS after FROM lines WHERE regexp_matches(line, '\btoken\b')""")
def rename_preview(spark, d):
    return I.rename_preview(T.lines(T.files(spark, d)), "token", "mark").select("path", "line_no", "sites", "after")


@query("edit_plan", """WITH e AS (SELECT DISTINCT p_brand AS path, p_partkey * 7 AS "start", p_partkey * 7 + p_size * 5 - 10 AS "end", p_type AS text FROM part)
SELECT a.*, CASE WHEN a."end" < a."start" THEN 'invalid' WHEN EXISTS (SELECT 1 FROM e b WHERE b.path = a.path AND b."end" >= b."start" AND (b."start", b."end", b.text) <> (a."start", a."end", a.text) AND b."start" < a."end" AND a."start" < b."end") THEN 'overlap' ELSE 'applicable' END AS state, row_number() OVER (PARTITION BY path ORDER BY "start" DESC, "end" DESC, text DESC) AS nth FROM e a""")
def edit_plan(spark, d):
    key = F.col("p_partkey")
    return I.edit_plan(T.table(spark, d, "part").select(F.col("p_brand").alias("path"), (key * 7).alias("start"), (key * 7 + F.col("p_size") * 5 - 10).alias("end"), F.col("p_type").alias("text")))

"""Registered import, dependent, reference and selector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import resolution as N
from tessera.plans.operations_queries import _FILES
from tessera.plans.registry import query
from tessera.plans.relation_queries import _EDGES, edges
from tessera.sources import tables as T

_RANGES = "p AS (SELECT p_brand AS path, p_partkey AS pos FROM part), r AS (SELECT p_brand AS path, p_partkey AS \"start\", p_partkey + p_size * 4 AS \"end\", p_name AS name FROM part)"
_MODULES = _RANGES.replace("p_name AS name FROM part)", "p_name AS name FROM part WHERE p_size % 3 = 0)")


def _points_ranges(spark, d, which="true"):
    parts = T.table(spark, d, "part")
    points = parts.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos"))
    ranges = parts.where(which).select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") * 4).alias("end"), F.col("p_name").alias("name"))
    return points, ranges


@query("references_in_symbol", f'WITH {_RANGES} SELECT path, pos, "start", "end", name FROM p JOIN r USING (path) WHERE pos BETWEEN "start" AND "end"')
def references_in_symbol(spark, d):
    return N.range_join(*_points_ranges(spark, d), ["path"], "pos")


@query("outside_test_modules", f'WITH {_MODULES} SELECT path, pos FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = p.path AND p.pos BETWEEN r."start" AND r."end")')
def outside_test_modules(spark, d):
    # every symbol holds its own first place: the test modules among them are what points can lie outside of
    return N.outside(*_points_ranges(spark, d, "p_size % 3 = 0"), ["path"], "pos")


#: Each file imports the next one by stem and the one after that relatively, from its own folder.
_IMPORTS = f"{_FILES}, e AS (SELECT DISTINCT a.path AS importer, b.path AS target FROM files a JOIN files b ON b.doc_id = a.doc_id + 1 AND a.language = b.language UNION SELECT a.path, b.path FROM files a JOIN files b ON b.doc_id = a.doc_id + 2 AND a.language = b.language AND a.source = b.source)"


def file_edges(spark, d):
    files = T.files(spark, d)
    names = F.explode(F.array((F.col("doc_id") + 1).cast("string"), F.concat(F.lit("."), (F.col("doc_id") + 2).cast("string"))))
    return N.import_edges(files.select(F.col("path").alias("importer"), "language", names.alias("name")), files.select("path", "language"))


@query("import_targets", f"{_IMPORTS} SELECT importer, target FROM e")
def import_targets(spark, d):
    return file_edges(spark, d)


@query("file_dependents", f"{_IMPORTS} SELECT target, count(DISTINCT importer) AS dependents, min(importer) AS first_importer FROM e GROUP BY target")
def file_dependents(spark, d):
    return file_edges(spark, d).groupBy("target").agg(F.count("*").alias("dependents"), F.min("importer").alias("first_importer"))


@query("dependents_by_tier", """WITH t AS (SELECT l_partkey AS part, l_orderkey AS dependent, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS tier FROM lineitem)
SELECT DISTINCT part, dependent, CAST(tier AS BIGINT) AS tier FROM t JOIN (SELECT part, min(tier) AS tier FROM t GROUP BY part) USING (part, tier)""")
def dependents_by_tier(spark, d):
    items = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("dependent"), "l_returnflag")
    tiers = [items.where(c).select("part", "dependent") for c in ("l_returnflag = 'R'", "l_returnflag = 'A'", "l_returnflag NOT IN ('R', 'A')")]
    return N.first_tier(tiers, "part").distinct()


@query("dependents_compact", "SELECT l_partkey AS part, count(*) FILTER (WHERE l_returnflag = 'A') AS calls, count(*) FILTER (WHERE l_returnflag = 'N') AS imports, count(*) FILTER (WHERE l_returnflag = 'R') AS types FROM lineitem GROUP BY l_partkey")
def dependents_compact(spark, d):
    wide = T.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return wide.select("part", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(n) for c, n in (("A", "calls"), ("N", "imports"), ("R", "types"))])


@query("reexport_dependents", f"""{_EDGES}, hubs AS (SELECT src AS hub, dst AS target FROM edges WHERE src % 10 = 3), two AS (SELECT DISTINCT x.hub, y.target FROM hubs x JOIN hubs y ON x.target = y.hub),
a AS (SELECT src AS importer, dst AS target, 0 AS hops FROM edges UNION ALL SELECT e.src, h.target, 1 FROM edges e JOIN hubs h ON e.dst = h.hub UNION ALL SELECT e.src, h.target, 2 FROM edges e JOIN two h ON e.dst = h.hub)
SELECT importer, target, CAST(min(hops) AS BIGINT) AS hops FROM a WHERE importer <> target GROUP BY importer, target""")
def reexport_dependents(spark, d):
    every = edges(spark, d)
    return N.through_reexports(every.select(F.col("src").alias("importer"), F.col("dst").alias("target")), every.where("src % 10 = 3").select(F.col("src").alias("hub"), F.col("dst").alias("target")))


@query("references_with_aliases", """WITH r AS (SELECT l_orderkey AS path, l_linenumber AS "start", CAST(l_partkey % 50 AS VARCHAR) AS name, CAST(l_suppkey % 50 AS VARCHAR) AS qualifier FROM lineitem), a AS (SELECT o_orderkey AS path, CAST(o_custkey % 50 AS VARCHAR) AS alias FROM orders WHERE o_orderkey % 3 = 0)
SELECT path, "start", name, qualifier FROM (SELECT *, row_number() OVER (PARTITION BY path, "start" ORDER BY name, qualifier) AS nth FROM r WHERE name = '7' OR qualifier = '7' OR EXISTS (SELECT 1 FROM a WHERE a.path = r.path AND a.alias = r.name)) WHERE nth = 1""")
def references_with_aliases(spark, d):
    text = lambda c: (F.col(c) % 50).cast("string")
    refs = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), text("l_partkey").alias("name"), text("l_suppkey").alias("qualifier"))
    aliases = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), text("o_custkey").alias("alias"), F.when(F.col("o_orderkey") % 3 == 0, "7").otherwise("8").alias("original"))
    return N.named_references(refs, aliases, "7")


@query("exact_references", """SELECT p_partkey, 'app::' || p_brand || '::' || p_type AS qualified FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_type = (SELECT min(p_type) FROM part) AND p_size % 7 <> 0""")
def exact_references(spark, d):
    parts = T.table(spark, d, "part")
    low = parts.agg(F.min("p_brand").alias("b"), F.min("p_type").alias("t")).first()
    own = f"{low.b}::{low.t}"
    refs = parts.select("p_partkey", F.concat(F.lit("app::"), F.concat_ws("::", "p_brand", "p_type")).alias("qualified"), F.when(F.col("p_size") % 7 == 0, own).alias("caller"))
    return N.exact_references(refs, low.b, low.t).select("p_partkey", "qualified")


@query("implementations", """SELECT c_custkey, c_mktsegment AS "trait", n_name AS "type" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' OR n_name = 'BUILDING'""")
def implementations(spark, d):
    nations = T.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("type"))
    rows = T.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("trait"), "type")
    return N.implementations(rows, "BUILDING")


@query("type_dependencies", f"""{_EDGES}, k AS (SELECT p_partkey AS name, min(p_brand) AS path FROM part WHERE p_size < 40 GROUP BY p_partkey), reach(name, depth) AS (SELECT name, 0 FROM k WHERE name IN (11, 12) UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.name JOIN k ON k.name = e.dst WHERE r.depth < 2)
SELECT CAST(name AS VARCHAR) AS name, CAST(min(depth) AS BIGINT) AS depth, path FROM reach JOIN k USING (name) GROUP BY name, path ORDER BY min(depth), CAST(name AS VARCHAR) LIMIT 15""")
def type_dependencies(spark, d):
    uses = edges(spark, d).select(F.col("src").cast("string").alias("name"), F.col("dst").cast("string").alias("used"))
    definitions = T.table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("path"))
    return N.type_dependencies(uses, definitions, ["11", "12"])


@query("ownership_globs", f"""{_FILES} SELECT path, CAST(regexp_matches(path, '^(?:.*/)?de/.*$') AS BIGINT) + CAST(regexp_matches(path, '^src1[^/]*/.*$') AS BIGINT) AS rules, CASE WHEN regexp_matches(path, '^src1[^/]*/.*$') THEN 'one' WHEN regexp_matches(path, '^(?:.*/)?de/.*$') THEN 'german' END AS owner FROM files""")
def ownership_globs(spark, d):
    return N.owned(T.files(spark, d), [("**/de/**", "german"), ("src1*/**", "one")])


@query("tracked_membership", f"{_FILES} SELECT path, doc_id IN (SELECT doc_id FROM labels) AS tracked FROM files")
def tracked_membership(spark, d):
    files = T.files(spark, d).select("doc_id", "path")
    return N.membership(files.select("path"), files.join(T.table(spark, d, "labels"), "doc_id", "left_semi"))


@query("generated_demoted", f"{_FILES}, p AS (SELECT path, doc_id, regexp_extract(path, '^((?:.*/)?(?:de|en))/', 1) AS folder FROM files) SELECT path FROM p WHERE folder <> '' AND doc_id % 13 <> 0 AND folder NOT IN (SELECT folder FROM p WHERE doc_id % 13 = 0)")
def generated_demoted(spark, d):
    files = T.files(spark, d).select("doc_id", "path")
    return N.demoted(files.where("doc_id % 13 <> 0"), files.where("doc_id % 13 = 0"), ["de", "en"]).select("path")


@query("unseen_callees", f"""{_EDGES}, f AS (SELECT p_partkey AS name FROM part WHERE p_partkey % 20 = 1) SELECT dst AS name, count(DISTINCT src) AS callers FROM edges WHERE src IN (SELECT name FROM f) AND dst NOT IN (SELECT name FROM f) AND dst IN (SELECT p_partkey FROM part WHERE p_size < 45) GROUP BY dst ORDER BY callers DESC, name LIMIT 10""")
def unseen_callees(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("name"), "p_size")
    return N.unseen_callees(edges(spark, d), parts.where("p_size < 45"), parts.where("name % 20 = 1"))


@query("gated_symbol_edges", f"""{_EDGES}, s AS (SELECT e.src, e.dst, a.p_brand AS anchor_path, b.p_brand AS partner_path FROM edges e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst), f AS (SELECT anchor_path AS anchor, partner_path AS partner FROM s GROUP BY ALL HAVING count(*) >= 3)
SELECT src, dst FROM s WHERE EXISTS (SELECT 1 FROM f WHERE f.anchor = s.anchor_path AND f.partner = s.partner_path)""")
def gated_symbol_edges(spark, d):
    at = lambda key, path: T.table(spark, d, "part").select(F.col("p_partkey").alias(key), F.col("p_brand").alias(path))
    sym = edges(spark, d).join(at("src", "anchor_path"), "src").join(at("dst", "partner_path"), "dst")
    linked = sym.groupBy(F.col("anchor_path").alias("anchor"), F.col("partner_path").alias("partner")).agg(F.count("*").alias("n")).where("n >= 3")
    return N.gated(sym, linked).select("src", "dst")


@query("callee_frequency", "SELECT l_partkey AS name, count(*) AS n, min(l_orderkey) AS first_line FROM lineitem GROUP BY l_partkey ORDER BY n DESC, name LIMIT 30")
def callee_frequency(spark, d):
    return N.callee_frequency(T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("line")))


@query("section_counts", "SELECT l_returnflag AS section, count(*) AS total, count(DISTINCT l_partkey) AS names, greatest(count(DISTINCT l_partkey) - 20, 0) AS overflow FROM lineitem GROUP BY l_returnflag")
def section_counts(spark, d):
    return N.section_counts(T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("name")))


@query("context_bundle", """WITH c AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)
SELECT 'callers' AS section, src AS name, count(*) AS n FROM c WHERE dst = 111 GROUP BY src UNION ALL SELECT 'callees', dst, count(*) FROM c WHERE src = 111 GROUP BY dst UNION ALL SELECT 'types', p.p_partkey, 1 FROM part p JOIN part s ON s.p_partkey = 111 AND p.p_type = s.p_type AND p.p_partkey <> 111""")
def context_bundle(spark, d):
    items = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    mine = items.where("l_partkey = 111").select("l_orderkey", "l_linenumber")
    side = lambda shift, section: items.withColumn("l_linenumber", F.col("l_linenumber") + shift).join(mine, ["l_orderkey", "l_linenumber"]).groupBy(F.lit(section).alias("section"), F.col("l_partkey").alias("name")).agg(F.count("*").alias("n"))
    parts = T.table(spark, d, "part").select("p_partkey", "p_type")
    types = parts.join(parts.where("p_partkey = 111").select("p_type").distinct(), "p_type", "left_semi").where("p_partkey <> 111").select(F.lit("types").alias("section"), F.col("p_partkey").alias("name"), F.lit(1).cast("long").alias("n"))
    return side(1, "callers").unionByName(side(-1, "callees")).unionByName(types)


@query("select_symbol", """WITH s AS (SELECT p_brand AS path, p_type AS name, CASE WHEN p_size % 10 = 0 THEN 'class' ELSE 'function' END AS kind, p_partkey AS line FROM part), q AS (SELECT p_partkey AS request, p_brand AS path, CASE WHEN p_partkey % 4 = 0 THEN 'app::' || p_type WHEN p_partkey % 4 = 1 THEN 'none' ELSE p_type END AS wanted, p_type AS leaf FROM part),
h AS (SELECT q.request, s.line, CASE WHEN s.kind = 'class' THEN 1 ELSE 3 END AS tier FROM q JOIN s ON s.path = q.path AND s.name = q.leaf AND q.wanted <> 'none'), m AS (SELECT request, count(*) AS candidates, min(tier) AS tier FROM h GROUP BY request), t AS (SELECT request, m.candidates, count(*) AS n, min(line) AS line FROM h JOIN m USING (request, tier) GROUP BY ALL)
SELECT request, CASE WHEN candidates IS NULL THEN 'not_found' WHEN candidates = 1 OR n = 1 THEN 'selected' ELSE 'ambiguous' END AS state, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 OR n = 1 THEN line END AS line FROM q LEFT JOIN t USING (request)""")
def select_symbol(spark, d):
    parts = T.table(spark, d, "part")
    symbols = parts.select(F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 10 == 0, "class").otherwise("function").alias("kind"), F.col("p_partkey").alias("line"))
    four = F.col("p_partkey") % 4
    wanted = F.when(four == 0, F.concat(F.lit("app::"), "p_type")).when(four == 1, "none").otherwise(F.col("p_type"))
    return N.select_symbol(symbols, parts.select(F.col("p_partkey").alias("request"), F.col("p_brand").alias("path"), wanted.alias("wanted"), F.lit(None).cast("string").alias("wanted_kind")))


@query("edit_impact", """WITH o AS (SELECT p_brand AS path, p_partkey AS name, p_retailprice AS body FROM part WHERE p_partkey % 11 <> 3), n AS (SELECT p_brand AS path, p_partkey AS name, CASE WHEN p_partkey % 11 = 4 THEN p_retailprice + 1 ELSE p_retailprice END AS body FROM part WHERE p_partkey % 11 <> 5),
c AS (SELECT path, name, CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n USING (path, name) WHERE o.body IS DISTINCT FROM n.body), k AS (SELECT c.*, l_orderkey, row_number() OVER (PARTITION BY path, name ORDER BY 'o' || l_orderkey) AS nth FROM c LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = name)
SELECT path, name, change, coalesce(string_agg('o' || l_orderkey, ',' ORDER BY 'o' || l_orderkey), '') AS callers FROM k WHERE nth <= 5 GROUP BY path, name, change""")
def edit_impact(spark, d):
    parts = T.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("body"))
    changed = F.when(F.col("name") % 11 == 4, F.col("body") + 1).otherwise(F.col("body"))
    callers = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"))
    return N.edit_impact(parts.where("name % 11 <> 3"), parts.where("name % 11 <> 5").withColumn("body", changed), callers)


@query("hunk_symbols", """WITH h AS (SELECT l_orderkey AS oid, p_brand AS path, p_partkey AS f, p_partkey + l_linenumber * 9 AS t FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT p_brand AS path, p_partkey AS name, p_partkey AS f, p_partkey + p_size * 3 AS t FROM part)
SELECT DISTINCT oid, path, name FROM h JOIN s USING (path) WHERE h.f <= s.t AND s.f <= h.t""")
def hunk_symbols(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    hunks = T.table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    hunks = hunks.select(F.col("l_orderkey").alias("oid"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("first"), (F.col("p_partkey") + F.col("l_linenumber") * 9).alias("last"))
    return N.hunk_symbols(hunks, parts.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("name"), F.col("p_partkey").alias("first"), (F.col("p_partkey") + F.col("p_size") * 3).alias("last")))

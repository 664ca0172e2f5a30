"""Registered queries over scopes, units, qualified calls and conventions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relations as R, scopes as C, units as U
from tessera.plans.operations_queries import _FILES
from tessera.plans.registry import query
from tessera.plans.relation_queries import _EDGES, edges
from tessera.sources import tables as T


@query("path_scopes", f"""{_FILES}, n AS (SELECT count(*) FILTER (WHERE starts_with(path, 'src1/')) AS folder, count(*) FILTER (WHERE starts_with(path, 'src1/en/')) AS deeper, count(*) FILTER (WHERE path = 'src1/en/1') AS exact_, count(*) AS every FROM files)
SELECT * FROM n""")
def path_scopes(spark, d):
    path = F.col("path")
    scopes = {"folder": C.in_path(path, prefix="src1/"), "deeper": C.in_path(path, prefix="src1/en"), "exact_": C.in_path(path, exact="src1/en/1"), "every": C.in_path(path)}
    return T.files(spark, d).agg(*[F.count_if(c).alias(k) for k, c in scopes.items()])


_LANES = f"{_FILES}, l AS (SELECT *, CASE WHEN language = 'en' THEN 'code' WHEN language = 'de' THEN 'text' ELSE 'binary' END AS kind, CASE WHEN doc_id % 3 = 0 THEN ['knowledge'] WHEN doc_id % 3 = 1 THEN ['code', 'knowledge'] END AS targets FROM files)"


def _lanes(spark, d):
    kind = F.when(F.col("language") == "en", "code").when(F.col("language") == "de", "text").otherwise("binary")
    targets = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("knowledge"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("code"), F.lit("knowledge")))
    return T.files(spark, d).withColumn("kind", kind).withColumn("targets", targets)


@query("lane_scopes", f"""{_LANES} SELECT count(*) AS all_, count(*) FILTER (WHERE coalesce(list_contains(targets, 'code'), kind = 'code')) AS code, count(*) FILTER (WHERE coalesce(list_contains(targets, 'knowledge'), kind = 'text')) AS text_, count(*) FILTER (WHERE kind = 'binary') AS binary_, count(*) FILTER (WHERE kind = 'text') AS by_class FROM l""")
def lane_scopes(spark, d):
    kind, targets = F.col("kind"), F.col("targets")
    scopes = {"all_": C.in_lane(kind, "all", targets), "code": C.in_lane(kind, "code", targets), "text_": C.in_lane(kind, "text", targets), "binary_": C.in_lane(kind, "binary", targets), "by_class": C.in_lane(kind, "text")}
    return _lanes(spark, d).agg(*[F.count_if(c).alias(k) for k, c in scopes.items()])


@query("language_scope", f"""{_FILES}, l AS (SELECT path, CASE language WHEN 'en' THEN 'Markdown' WHEN 'de' THEN 'cpp' ELSE 'python' END AS language FROM files) SELECT path, language FROM l WHERE language IN ('Markdown', 'cpp')""")
def language_scope(spark, d):
    named = F.when(F.col("language") == "en", "Markdown").when(F.col("language") == "de", "cpp").otherwise("python")
    files = T.files(spark, d).select("path", named.alias("language"))
    known = ["markdown", "cpp", "python"]
    return files.where(C.in_language(F.col("language"), " MD ", known) | C.in_language(F.col("language"), "c++", known))


_KINDS = "CASE p_size % 4 WHEN 0 THEN 'fn' WHEN 1 THEN 'let' WHEN 2 THEN 'class' ELSE 'mod' END"


@query("kind_filter", f"SELECT count(*) FILTER (WHERE k = 'fn') AS functions, count(*) FILTER (WHERE k = 'let') AS variables, count(*) FILTER (WHERE k = 'class') AS classes, count(*) AS every FROM (SELECT {_KINDS} AS k FROM part)")
def kind_filter(spark, d):
    kind = F.expr(_KINDS)
    asked = {"functions": "Function", "variables": "let", "classes": "class", "every": "all"}
    return T.table(spark, d, "part").agg(*[F.count_if(C.of_kind(kind, w)).alias(k) for k, w in asked.items()])


_TIERS = f"{_FILES}, t AS (SELECT path, byte_len, CASE WHEN language IN ('en', 'de') THEN language END AS language, CASE WHEN byte_len > 8000 THEN 'too_large' ELSE 'normal' END AS tier FROM files)"


def _decisions(spark, d):
    language = F.when(F.col("language").isin("en", "de"), F.col("language"))
    tier = C.reconciled(F.when(F.col("byte_len") > 8000, "too_large").otherwise("normal"), language)
    return T.files(spark, d).select("path", "byte_len", language.alias("language"), tier.alias("tier"))


@query("unsupported_languages", f"{_TIERS} SELECT CASE WHEN tier = 'normal' AND language IS NULL THEN 'unsupported_language' ELSE tier END AS tier, count(*) AS n FROM t GROUP BY 1")
def unsupported_languages(spark, d):
    return _decisions(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("admission_lookup", f"{_TIERS} SELECT path, tier, byte_len, language, NULL::VARCHAR AS extension, CASE WHEN tier <> 'normal' THEN 'size' END AS reason FROM t WHERE path = (SELECT min(path) FROM t WHERE language IS NOT NULL)")
def admission_lookup(spark, d):
    decisions = _decisions(spark, d).withColumn("reason", F.when(F.col("tier") != "normal", "size"))
    path = decisions.where("language IS NOT NULL").agg(F.min("path").alias("p")).first().p
    return C.admission_of(decisions, f"./{path}".replace("/", "\\"))


@query("graph_size", f"{_EDGES} SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS isolated")
def graph_size(spark, d):
    return C.graph_size(T.table(spark, d, "part").select(F.col("p_partkey").alias("node")), edges(spark, d))


_CALLS = """d AS (SELECT p_partkey AS node, p_type AS name, p_brand AS folder, 'm' || p_size AS stem, 'T' || (p_partkey % 90) AS owner FROM part
UNION ALL SELECT -p_partkey, 'only' || p_partkey, p_brand, 'm' || p_size, NULL FROM part WHERE p_partkey % 5 = 0),
c AS (SELECT l_orderkey * 10 + l_linenumber AS call, CASE WHEN l_partkey % 5 = 0 AND l_linenumber % 2 = 0 THEN 'only' || l_partkey ELSE p_type END AS name,
CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'm' || p_size WHEN 2 THEN p_brand ELSE 'T' || (l_partkey % 90) END AS hint FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("qualified_calls", f"""WITH {_CALLS}, one AS (SELECT name, min(node) AS node FROM d GROUP BY name HAVING count(*) = 1), s AS (SELECT call, c.name, one.node FROM c JOIN one USING (name)),
q AS (SELECT * FROM c WHERE hint IS NOT NULL AND name NOT IN (SELECT name FROM one)),
p AS (SELECT call, q.name, count(*) AS n, min(node) AS node FROM q JOIN d ON d.name = q.name AND hint IN (folder, stem, stem || '.rs', 'src') GROUP BY ALL),
o AS (SELECT call, q.name, count(*) AS n, min(node) AS node FROM q JOIN d ON d.name = q.name AND hint = owner GROUP BY ALL)
SELECT * FROM s UNION ALL SELECT call, name, node FROM p WHERE n = 1 UNION ALL SELECT call, name, node FROM o WHERE n = 1 AND call NOT IN (SELECT call FROM p)""")
def qualified_calls(spark, d):
    parts = T.table(spark, d, "part")
    path = F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/m"), F.col("p_size").cast("string"), F.lit(".rs"))
    key = F.col("p_partkey")
    several = parts.select(key.alias("node"), F.col("p_type").alias("name"), path.alias("path"), F.concat(F.lit("T"), (key % 90).cast("string")).alias("owner"))
    single = parts.where("p_partkey % 5 = 0").select((-key).alias("node"), F.concat(F.lit("only"), key.cast("string")).alias("name"), path.alias("path"), F.lit(None).cast("string").alias("owner"))
    called = T.table(spark, d, "lineitem").join(parts, F.col("l_partkey") == key)
    four = F.col("l_linenumber") % 4
    name = F.when((F.col("l_partkey") % 5 == 0) & (F.col("l_linenumber") % 2 == 0), F.concat(F.lit("only"), F.col("l_partkey").cast("string"))).otherwise(F.col("p_type"))
    hint = F.when(four == 1, F.concat(F.lit("m"), F.col("p_size").cast("string"))).when(four == 2, F.col("p_brand")).when(four == 3, F.concat(F.lit("T"), (F.col("l_partkey") % 90).cast("string")))
    calls = called.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), name.alias("name"), F.concat(F.lit("app::"), hint, F.lit("::"), name).alias("qualified"))
    return R.resolve_qualified(calls, several.unionByName(single))


@query("repository_map", f"""{_FILES}, s AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, count(*) AS n FROM documents JOIN part ON doc_id = p_partkey % 700 GROUP BY 1), r AS (SELECT language, source || '/' || language AS folder, byte_len, coalesce(n, 0) AS n FROM files LEFT JOIN s USING (path))
SELECT language, folder, count(*) AS n_files, CAST(sum(byte_len) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS n_symbols FROM r GROUP BY GROUPING SETS ((), (language), (folder))""")
def repository_map(spark, d):
    files = T.files(spark, d)
    symbols = T.table(spark, d, "part").select((F.col("p_partkey") % 700).alias("doc_id")).join(files.select("doc_id", "path"), "doc_id").select("path")
    return U.repository_map(files, symbols)


@query("language_vote", f"""{_FILES}, v AS (SELECT CASE WHEN doc_id % 9 < 4 THEN 'typescript' WHEN doc_id % 9 < 7 THEN 'python' ELSE language END AS bucket, CASE WHEN doc_id % 9 = 0 THEN 'typescript' WHEN doc_id % 9 < 4 THEN 'javascript' END AS own FROM files WHERE doc_id % 9 < 7),
b AS (SELECT bucket, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, bucket) AS nth, sum(count(*)) OVER () AS total FROM v GROUP BY bucket)
SELECT 'javascript' AS language, CAST(floor(100 * (SELECT n FROM b WHERE nth = 1) / max(total)) AS BIGINT) AS percent, max(bucket) FILTER (WHERE nth = 2 AND n * 100 > total * 25) AS second, CAST(floor(100 * max(n) FILTER (WHERE nth = 2 AND n * 100 > total * 25) / max(total)) AS BIGINT) AS second_percent FROM b""")
def language_vote(spark, d):
    nine = F.col("doc_id") % 9
    files = T.files(spark, d).withColumn("language", F.when(nine == 0, "typescript").when(nine < 4, "javascript").when(nine < 7, "python").otherwise(F.col("language")))
    return U.language_vote(files, {"javascript": "typescript"}, ["typescript", "javascript", "python"])


@query("conventions_by_language", f"""{_FILES}, f AS (SELECT language, count(*) AS n_files, count(*) FILTER (WHERE contains(path, '7')) AS n_tests, max(byte_len) AS largest, round(avg(byte_len), 6) AS mean_bytes, count(*) FILTER (WHERE language = 'en' AND contains(content, 'the')) AS articles, count(*) FILTER (WHERE language = 'de' AND contains(content, 'license')) AS licensed FROM files GROUP BY language),
n AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'de' END AS language, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_brand, '#', '') ELSE 'do' || replace(p_brand, '#', '') END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'fn' ELSE 'class' END AS kind FROM part),
s AS (SELECT language, count(*) FILTER (WHERE kind = 'fn' AND regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$')) AS snake_functions, count(*) FILTER (WHERE kind = 'fn' AND regexp_matches(name, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$')) AS camel_functions, count(*) FILTER (WHERE kind = 'fn') AS functions, count(*) FILTER (WHERE kind <> 'fn' AND regexp_matches(name, '^([A-Z][a-z0-9]*)+$')) AS pascal_types, count(*) FILTER (WHERE kind <> 'fn') AS types FROM n GROUP BY language)
SELECT f.*, coalesce(snake_functions, 0) AS snake_functions, coalesce(camel_functions, 0) AS camel_functions, coalesce(functions, 0) AS functions, coalesce(pascal_types, 0) AS pascal_types, coalesce(types, 0) AS types FROM f LEFT JOIN s USING (language)""")
def conventions_by_language(spark, d):
    files = T.files(spark, d).withColumn("test", F.col("path").contains("7"))
    three, brand = F.col("p_size") % 3, F.replace("p_brand", F.lit("#"), F.lit(""))
    name = F.when(three == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(three == 1, brand).otherwise(F.concat(F.lit("do"), brand))
    symbols = T.table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "en").otherwise("de").alias("language"), name.alias("name"), F.when(F.col("p_partkey") % 2 == 0, "fn").otherwise("class").alias("kind"))
    return U.conventions(files, symbols, {"articles": ("en", "the"), "licensed": ("de", "license")})


_TAG = "<h[1-6][^>]*>[^<]*</h[1-6]>"
#: Headings of pages, as Markdown: front matter, then seven lines each, the last five with a fence of one of three kinds.
_HEADS = f"""h AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}')) AS tag, unnest(range(1, len(regexp_extract_all(html, '{_TAG}')) + 1)) AS nth FROM pages),
u AS (SELECT page_id, nth AS unit, CAST(regexp_extract(tag, '<h([1-6])', 1) AS BIGINT) AS level, trim(regexp_extract(tag, '>([^<]*)<', 1)) AS heading FROM h),
p AS (SELECT *, 3 + 7 * (unit - 1) + CASE WHEN level <= 2 AND unit % 2 = 1 THEN 1 ELSE 2 END AS first_line, max(unit) OVER (PARTITION BY page_id) AS units FROM u)"""


def _page_lines(spark, d):
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))

    def block(tag, i):
        level, heading = F.regexp_extract(tag, "<h([1-6])", 1).cast("int"), F.trim(F.regexp_extract(tag, ">([^<]*)<", 1))
        fences = (["```", "# no heading", "~~~", "# nor this", "```"], ["~~~~ text", "```", "# no heading", "~~~", "~~~~~"], ["   ```", "```x", "# no heading", "````", "said"])
        under = F.when(level == 1, "====").otherwise("---")
        signs = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), heading)
        lines = F.when((level <= 2) & (i % 2 == 0), F.array(heading, under)).otherwise(F.array(F.lit(""), signs))
        return F.concat(lines, F.get(F.array(*[F.array(*map(F.lit, f)) for f in fences]), i % 3))

    top = F.array(F.lit("---"), F.lit("# title: none"), F.lit("---"))
    every = T.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.posexplode(F.concat(top, F.flatten(F.transform(tags, block)))).alias("at", "line"))
    return every.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


@query("knowledge_units", f"""WITH RECURSIVE {_HEADS}, q AS (SELECT p.*, (SELECT max(x.unit) FROM p x WHERE x.page_id = p.page_id AND x.unit < p.unit AND x.level < p.level) AS parent, (SELECT min(x.first_line) FROM p x WHERE x.page_id = p.page_id AND x.unit > p.unit AND x.level <= p.level) AS ends FROM p),
w AS (SELECT page_id, unit, heading AS names, parent AS up FROM q UNION ALL SELECT w.page_id, w.unit, q.heading || ' > ' || w.names, q.parent FROM w JOIN q ON q.page_id = w.page_id AND q.unit = w.up)
SELECT CAST(q.page_id AS VARCHAR) AS path, q.unit, level, names AS heading_path, parent, first_line, coalesce(ends, 4 + 7 * units) - 1 AS last_line FROM q JOIN w ON w.page_id = q.page_id AND w.unit = q.unit WHERE up IS NULL""")
def knowledge_units(spark, d):
    return U.sections(_page_lines(spark, d)).withColumn("heading_path", F.array_join("heading_path", " > "))


_UNITS = """u AS (SELECT CASE lang WHEN 'en' THEN 0 ELSE 1 END AS source_rank, source || '/' || lang AS path, doc_id * 1000 AS unit_start, source AS heading, coalesce(text, '') AS text FROM documents)"""


@query("unit_search", f"""WITH {_UNITS}, m AS (SELECT source_rank, path, unit_start, lower(heading) AS h, lower(text) AS t, list_transform(['the', 'license', 'src1'], lambda w: contains(lower(text), w) OR contains(lower(heading), w)) AS words,
list_transform(string_split(lower(text), chr(10)), lambda x: CASE WHEN contains(x, 'the license src1') THEN 2 WHEN contains(x, 'the') OR contains(x, 'license') OR contains(x, 'src1') THEN 1 ELSE 0 END) AS marks FROM u),
f AS (SELECT source_rank, path, unit_start, contains(t, 'the license src1') OR contains(h, 'the license src1') AS exact_phrase, contains(h, 'the') OR contains(h, 'license') OR contains(h, 'src1') AS heading_match, len(list_filter(words, lambda x: x)) AS distinct_terms, unit_start + coalesce(list_position(marks, 2), list_position(marks, 1), 1) - 1 AS line FROM m)
SELECT * FROM f WHERE exact_phrase OR distinct_terms > 0 ORDER BY exact_phrase DESC, heading_match DESC, distinct_terms DESC, source_rank, path, line, unit_start LIMIT 25""")
def unit_search(spark, d):
    docs = T.table(spark, d, "documents")
    units = docs.select(F.when(F.col("lang") == "en", 0).otherwise(1).alias("source_rank"), F.concat_ws("/", "source", "lang").alias("path"), (F.col("doc_id") * 1000).alias("unit_start"), F.col("source").alias("heading"), "text")
    return U.search(units, "The license  src1", limit=25)

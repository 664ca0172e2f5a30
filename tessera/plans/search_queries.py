"""Registered search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.plans.registry import query
from tessera.sources import tables as T

_LINES = r"""
WITH files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS content FROM documents),
lines AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, regexp_replace(unnest(string_split(content, chr(10))), '\r$', '') AS line FROM files)
"""


def _text_sql(where: str, per_file: int, total: int) -> str:
    return f"""{_LINES}, hits AS (SELECT * FROM lines WHERE {where}),
counted AS (SELECT path, count(*) AS matches FROM hits GROUP BY path),
budget AS (SELECT *, {total} - coalesce(sum(least(matches, {per_file})) OVER (ORDER BY matches DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM counted),
shown AS (SELECT h.path, h.line_no, h.line, b.matches, b.left_, row_number() OVER (PARTITION BY h.path ORDER BY h.line_no) AS nth FROM hits h JOIN budget b ON h.path = b.path WHERE b.left_ > 0)
SELECT path, line_no, line, matches FROM shown WHERE nth <= {per_file} AND nth <= left_"""


TERM, TERMS, PATTERN, WORD = "license", ["token", "password", "license"], r"[0-9]{3}\.[0-9]+", "cc"


@query("text_search_literal", _text_sql(f"contains(lower(line), '{TERM}')", 5, 50))
def text_search_literal(spark, d):
    return S.text_search(T.lines(T.files(spark, d)), S.literal(TERM))


@query("text_search_regex", _text_sql(f"regexp_matches(line, '{PATTERN}')", 5, 50))
def text_search_regex(spark, d):
    return S.text_search(T.lines(T.files(spark, d)), S.regex(PATTERN))


@query("text_search_multi_term", _text_sql(" OR ".join(f"contains(lower(line), '{t}')" for t in TERMS), 5, 150))
def text_search_multi_term(spark, d):
    return S.text_search(T.lines(T.files(spark, d)), S.any_of(TERMS), total=50 * len(TERMS))


@query("text_search_whole_word", _text_sql(f"regexp_matches(line, '(?i)(^|[^0-9A-Za-z_]){WORD}($|[^0-9A-Za-z_])')", 2, 20))
def text_search_whole_word(spark, d):
    return S.text_search(T.lines(T.files(spark, d)), S.whole_word(WORD), per_file=2, total=20)


@query("text_search_totals", f"""{_LINES} SELECT count(*) FILTER (WHERE NOT h) AS matches, count(DISTINCT path) FILTER (WHERE NOT h) AS files, count(*) FILTER (WHERE h) AS suppressed
FROM (SELECT path, path LIKE '%/de/%' AS h FROM lines WHERE contains(lower(line), '{TERM}'))""")
def text_search_totals(spark, d):
    return S.search_totals(T.lines(T.files(spark, d)), S.literal(TERM), F.col("path").contains("/de/"))


@query("text_search_context", f"""{_LINES}, sizes AS (SELECT path, max(line_no) AS last FROM lines GROUP BY path),
near AS (SELECT DISTINCT l.path, unnest(range(greatest(1, l.line_no - 2), least(s.last, l.line_no + 2) + 1)) AS line_no FROM lines l JOIN sizes s ON l.path = s.path WHERE contains(lower(line), '{TERM}')),
marked AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY path ORDER BY line_no) <= 1 THEN 0 ELSE 1 END AS fresh FROM near),
blocks AS (SELECT path, line_no, CAST(sum(fresh) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) AS block FROM marked)
SELECT path, block, min(line_no) AS first_line, max(line_no) AS last_line FROM blocks GROUP BY path, block""")
def text_search_context(spark, d):
    return S.context_windows(T.lines(T.files(spark, d)), S.literal(TERM), 2)


@query("text_search_ranked", f"""{_LINES}, hits AS (SELECT path, count(*) AS matches FROM lines WHERE contains(lower(line), 'the') GROUP BY path),
extra AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, doc_id % 31 AS callers, coalesce(toxic, 0) AS churn, CASE lang WHEN 'en' THEN 0.8 WHEN 'de' THEN 0.4 ELSE 0.1 END AS kind_priority FROM documents LEFT JOIN labels USING (doc_id)),
picked AS (SELECT hits.path, matches, callers, churn, kind_priority FROM hits JOIN extra ON hits.path = extra.path ORDER BY matches DESC, hits.path LIMIT 500)
SELECT path, matches, round(CAST(0.30 AS DOUBLE) * matches / max(matches) OVER () + CAST(0.40 AS DOUBLE) * least(callers / 20.0, 1.0) + CAST(0.15 AS DOUBLE) * churn + CAST(0.15 AS DOUBLE) * CAST(kind_priority AS DOUBLE), 6) AS score FROM picked""")
def text_search_ranked(spark, d):
    files = T.files(spark, d)
    hits = T.lines(files).where(S.literal("the")).groupBy("path").agg(F.count("*").alias("matches"))
    kind = F.when(F.col("language") == "en", 0.8).when(F.col("language") == "de", 0.4).otherwise(0.1)
    extra = files.join(T.table(spark, d, "labels"), "doc_id", "left").select("path", (F.col("doc_id") % 31).alias("callers"), F.coalesce("toxic", F.lit(0)).cast("double").alias("churn"), kind.alias("kind_priority"))
    return S.importance(hits.join(extra, "path")).select("path", "matches", "score")


_SYMBOLS = "WITH symbols AS (SELECT lower(p_type) || '/' || p_brand AS path, p_name AS name, lower(p_type) AS kind, CAST(p_size AS BIGINT) AS depth, p_partkey AS line FROM part)"


@query("symbol_search", f"""{_SYMBOLS}, t AS (SELECT *, CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 WHEN contains(lower(name), 'red') THEN 2 END AS tier FROM symbols)
SELECT path, name, kind, depth, line, CAST(tier AS BIGINT) AS tier, CAST(CASE tier WHEN 0 THEN 0 WHEN 1 THEN length(name) ELSE instr(lower(name), 'red') END AS BIGINT) AS tie FROM t WHERE tier IS NOT NULL ORDER BY tier, tie, name, path, line LIMIT 40""")
def symbol_search(spark, d):
    return S.symbol_search(T.symbols(spark, d), "red", limit=40)


@query("symbol_browse", f"""{_SYMBOLS}, refs AS (SELECT p_name AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
j AS (SELECT s.*, coalesce(n, 0) AS ref_count, row_number() OVER (PARTITION BY s.name, kind ORDER BY path, line) AS nth FROM symbols s LEFT JOIN refs ON s.name = refs.name)
SELECT path, name, kind, depth, line, ref_count FROM j WHERE nth = 1 ORDER BY ref_count DESC, kind, path, line, name LIMIT 25""")
def symbol_browse(spark, d):
    refs = T.table(spark, d, "lineitem").select("l_partkey").join(T.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), F.col("l_partkey") == F.col("p_partkey")).select("name")
    return S.symbol_browse(T.symbols(spark, d), refs, limit=25)


@query("did_you_mean", """WITH n AS (SELECT name, lower(name) AS low, 'rde bolts' AS q, len(list_filter(range(1, 10), lambda i: starts_with(lower(name), 'rde bolts'[1:i]))) AS beginning,
len(list_intersect(string_split(lower(name), ''), string_split('rde bolts', ''))) AS shared, greatest(strlen(name), 9) AS longest FROM (SELECT DISTINCT p_name AS name FROM part WHERE strlen(p_name) >= 2)),
s AS (SELECT name, CAST(CASE WHEN contains(low, q) OR contains(q, low) THEN 0 WHEN beginning > 0 THEN longest - beginning WHEN shared > 0 THEN longest - shared END AS BIGINT) AS distance FROM n)
SELECT name, distance FROM s WHERE distance IS NOT NULL ORDER BY distance, name LIMIT 5""")
def did_you_mean(spark, d):
    return S.did_you_mean(T.symbols(spark, d), "rde bolts")


_PATHS = "WITH files AS (SELECT DISTINCT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents)"
_PATH_TIER = "CASE WHEN ends_with(lower(path), '/' || '{q}') OR lower(path) = '{q}' THEN 0 WHEN string_split(lower(path), '/')[-1] = '{q}' THEN 1 WHEN starts_with(string_split(lower(path), '/')[-1], '{q}') THEN 2 WHEN contains(lower(path), '{q}') THEN 3 END"


@query("path_search", f"""{_PATHS}, t AS (SELECT path, {_PATH_TIER.format(q='en/1')} AS tier FROM files)
SELECT path, CAST(tier AS BIGINT) AS tier FROM t WHERE tier IS NOT NULL ORDER BY tier, length(path), path LIMIT 20""")
def path_search(spark, d):
    return S.path_search(T.files(spark, d), "en/1")


@query("path_resolve", f"""{_PATHS}, t AS (SELECT path, {_PATH_TIER.format(q='17')} AS tier FROM files), b AS (SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)),
c AS (SELECT count(*) AS candidates, min(path) AS first_path FROM b)
SELECT CASE WHEN candidates = 1 THEN 'resolved' WHEN candidates > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, candidates, first_path FROM c""")
def path_resolve(spark, d):
    return S.path_resolve(T.files(spark, d), "17")


@query("trigram_search", "SELECT DISTINCT p_partkey AS id, p_name AS text FROM part WHERE contains(lower(p_name), 'l bolt')")
def trigram_search(spark, d):
    units = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    grams = units.select("id", F.explode(S.trigrams(F.col("text"))).alias("gram"))
    return S.trigram_search(grams, units, "l bolt")


@query("trigram_search_texts", "SELECT doc_id AS id, text FROM documents WHERE contains(lower(text), 'license')")
def trigram_search_texts(spark, d):
    units = T.files(spark, d).select(F.col("doc_id").alias("id"), F.col("content").alias("text"))
    grams = units.select("id", F.explode(S.trigrams(F.col("text"))).alias("gram"))
    return S.trigram_search(grams, units, "license")


@query("rank_fusion", """WITH t AS (SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN 1000 WHEN ends_with(p_name, 'bolt') THEN 100 WHEN starts_with(p_name, 'red') THEN 50 ELSE 10 END AS path_match, p_retailprice FROM part)
SELECT p_partkey, round(CAST(0.6 AS DOUBLE) * path_match / 1000 + CAST(0.4 AS DOUBLE) * p_retailprice / max(p_retailprice) OVER (), 6) AS score FROM t ORDER BY score DESC, p_partkey LIMIT 30""")
def rank_fusion(spark, d):
    parts = T.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    tier = F.when(F.col("p_name") == "red bolt", 1000).when(F.col("p_name").endswith("bolt"), 100).when(F.col("p_name").startswith("red"), 50).otherwise(10)
    most = parts.agg(F.max("p_retailprice").alias("most"))
    fused = S.fuse(parts.crossJoin(F.broadcast(most)), {"path": (0.6, tier / 1000), "price": (0.4, F.col("p_retailprice") / F.col("most"))})
    return fused.orderBy(F.desc("score"), "p_partkey").limit(30).select("p_partkey", "score")


PHRASE_TERMS = ["the", "bleth", "erent"]


@query("knowledge_search", f"""{_LINES}, t AS (SELECT path, line_no, {' + '.join(f"CASE WHEN contains(lower(line), '{t}') THEN 1 ELSE 0 END" for t in PHRASE_TERMS)} AS terms, contains(lower(line), '{' '.join(PHRASE_TERMS[:2])}') AS phrase FROM lines)
SELECT path, line_no, CAST(terms AS BIGINT) AS terms, phrase FROM t WHERE terms > 0 ORDER BY phrase DESC, terms DESC, path, line_no LIMIT 10""")
def knowledge_search(spark, d):
    every = T.lines(T.files(spark, d))
    terms = sum((F.when(F.lower("line").contains(t), 1).otherwise(0) for t in PHRASE_TERMS), F.lit(0))
    found = every.select("path", "line_no", terms.cast("long").alias("terms"), F.lower("line").contains(" ".join(PHRASE_TERMS[:2])).alias("phrase")).where("terms > 0")
    return found.orderBy(F.desc("phrase"), F.desc("terms"), "path", "line_no").limit(10)


@query("line_windows", f"""{_LINES} SELECT path, (line_no - 1) // 20 AS chunk, count(*) AS n_lines, min(line_no) AS first_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY ALL""")
def line_windows(spark, d):
    chunk = F.floor((F.col("line_no") - 1) / 20).alias("chunk")
    return T.lines(T.files(spark, d)).groupBy("path", chunk).agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.sum(F.length("line")).alias("n_chars"))


@query("page_sections", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>')) AS tag, unnest(range(1, len(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>')) + 1)) AS nth FROM pages)
SELECT page_id, nth, CAST(regexp_extract(tag, '<h([1-6])', 1) AS BIGINT) AS depth, regexp_extract(tag, '>([^<]*)<', 1) AS heading FROM h""")
def page_sections(spark, d):
    tags = T.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*</h[1-6]>"), F.lit(0))).alias("at", "tag"))
    return tags.select("page_id", (F.col("at") + 1).cast("long").alias("nth"), F.regexp_extract("tag", "<h([1-6])", 1).cast("long").alias("depth"), F.regexp_extract("tag", ">([^<]*)<", 1).alias("heading"))


@query("config_keys", """SELECT k AS key, count(*) AS n, CAST(min(json_extract_string(props, '$.' || k)) AS VARCHAR) AS least FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY k""")
def config_keys(spark, d):
    rows = T.table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("least"))

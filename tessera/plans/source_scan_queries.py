"""Trees under ignore rules, history as a log, changed paths of versions, budgets of refs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import secrecy as Y, structure as X
from tessera.plans.registry import query
from tessera.plans.source_queries import _SQL, sources
from tessera.scratch import root
from tessera.sources import commit_log as L, ignore as G, tables as T

#: Rule files of the tree that the documents stand in (folder, content).
RULES = [
    ("", "# top\n*7\n!/src1*/en/\nsrc2/**/1*\n/src3/de/\n\nsrc4/\n!src4/en/5"),
    ("src0", "[0-4]?\n!*2\n"),
    ("src0/en", "!*7\n/12*\n"),
]


@query("tree_dispositions", r"""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path, source, lang, CAST(doc_id AS VARCHAR) AS n, octet_length(encode(text)) AS byte_len FROM documents),
m AS (SELECT *, CASE WHEN source = 'src0' AND lang = 'en' AND regexp_matches(n, '^12') THEN true WHEN source = 'src0' AND lang = 'en' AND n LIKE '%7' THEN false
 WHEN source = 'src0' AND n LIKE '%2' THEN false WHEN source = 'src0' AND regexp_matches(n, '^[0-4].$') THEN true
 WHEN source = 'src2' AND n LIKE '1%' THEN true WHEN n LIKE '%7' THEN true ELSE false END AS own FROM f)
SELECT path, byte_len, CASE WHEN (source LIKE '%7') OR (lang LIKE '%7') OR (source = 'src3' AND lang = 'de') OR source = 'src4' OR own THEN 'ignored' WHEN byte_len IS NULL THEN 'unreadable' WHEN byte_len > 100 * 1048576 THEN 'hard_skip' WHEN byte_len > 4 * 1048576 THEN 'too_large' ELSE 'ingest' END AS disposition FROM m""")
def tree_dispositions(spark, d):
    docs = T.table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    entries = docs.select(path.alias("path"), F.lit(False).alias("is_folder"), F.octet_length("text").cast("long").alias("byte_len"))
    ruled = G.rules(spark.createDataFrame(RULES, "folder string, content string"))
    return G.dispositions(entries, ruled)


def _log(spark, d):
    """The log of all orders, written below the shared folder; its place."""
    commits = T.commits(spark, d).select("oid", F.unix_timestamp("ts").alias("unix"), "author", F.concat(F.lit("order of "), F.col("ts").cast("date").cast("string")).alias("subject"))
    files = T.commit_files(spark, d).select("oid", F.lit("M").alias("status"), "path")
    at = f"{root(spark)}/tessera/commit-log"
    L.write(commits, files, at)
    return at


_COMMITS = """WITH c AS (SELECT o_orderkey AS oid, CAST(epoch(o_orderdate) AS BIGINT) AS unix, o_custkey AS author, 'order of ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS subject FROM orders),
p AS (SELECT DISTINCT l_orderkey AS oid, lower(p_type) || '/' || p_brand AS path FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("commit_log_since", f"""{_COMMITS} SELECT CAST(c.oid AS VARCHAR) AS oid, unix, CAST(author AS VARCHAR) AS author, subject, path FROM c JOIN p USING (oid) WHERE unix >= 946684800""")
def commit_log_since(spark, d):
    return L.scan(spark, _log(spark, d), cutoff=946_684_800).select("oid", "unix", "author", "subject", "path")


@query("commit_log_newest", f"""{_COMMITS}, n AS (SELECT DISTINCT c.oid, unix FROM c JOIN p USING (oid) ORDER BY unix DESC, CAST(c.oid AS VARCHAR) LIMIT 500) SELECT CAST(n.oid AS VARCHAR) AS oid, unix, path FROM n JOIN p USING (oid)""")
def commit_log_newest(spark, d):
    return L.scan(spark, _log(spark, d), max_commits=500).select("oid", "unix", "path")


_VERSIONS = """WITH v AS (SELECT o_orderkey AS path, sum(l_quantity) AS q, count(*) AS n, o_orderstatus AS st FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
base AS (SELECT path, q AS digest FROM v WHERE st <> 'O'), head AS (SELECT path, CASE WHEN n % 3 = 0 THEN q + 1 ELSE q END AS digest FROM v WHERE n <> 2),
w AS (SELECT path, CASE WHEN n % 4 = 0 THEN q + 2 WHEN n % 3 = 0 THEN q + 1 ELSE q END AS digest, n <> 1 AND n <> 2 AS tracked, n = 1 AS staged FROM v WHERE n <> 5)"""


@query("changed_paths", f"""{_VERSIONS}, one AS (SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM base b FULL JOIN head h USING (path) WHERE b.digest IS DISTINCT FROM h.digest),
two AS (SELECT path, CASE WHEN h.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM head h FULL JOIN (SELECT * FROM w WHERE tracked OR staged) t USING (path) WHERE h.digest IS DISTINCT FROM t.digest),
three AS (SELECT path, 'untracked' AS change FROM w WHERE NOT tracked AND NOT staged)
SELECT path, arg_min(change, nth) AS change FROM (SELECT *, 0 AS nth FROM one UNION ALL SELECT *, 1 FROM two UNION ALL SELECT *, 2 FROM three) GROUP BY path""")
def changed_paths(spark, d):
    items = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    v = items.join(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus"), "path")
    head = F.when(F.col("n") % 3 == 0, F.col("q") + 1).otherwise(F.col("q"))
    tree = v.where("n <> 5").select("path", F.when(F.col("n") % 4 == 0, F.col("q") + 2).otherwise(head).alias("digest"), (~F.col("n").isin(1, 2)).alias("tracked"), (F.col("n") == 1).alias("staged"))
    return L.changed_paths(v.where("o_orderstatus <> 'O'").select("path", F.col("q").alias("digest")), v.where("n <> 2").select("path", head.alias("digest")), tree)


_REFS = """WITH r AS (SELECT source AS ref, lang || '/' || doc_id AS path, octet_length(encode(coalesce(text, ''))) AS byte_len FROM documents),
s AS (SELECT *, sum(byte_len) OVER w AS b, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY ref ORDER BY path ROWS UNBOUNDED PRECEDING))"""


def _refs(spark, d):
    docs = T.table(spark, d, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    refs = docs.select(F.col("source").alias("ref"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), size.alias("byte_len"))
    return L.within_budget(refs, 20_000, 60)


@query("ref_catalog", f"{_REFS} SELECT ref, path, byte_len FROM s WHERE b <= 20000 AND n <= 60")
def ref_catalog(spark, d):
    return _refs(spark, d)[0]


@query("ref_remainder", f"{_REFS} SELECT ref, count(*) AS n_files, CAST(sum(byte_len) AS BIGINT) AS bytes FROM s WHERE NOT (b <= 20000 AND n <= 60) GROUP BY ref")
def ref_remainder(spark, d):
    return _refs(spark, d)[1]


def _count(rule: Y.Rule) -> str:
    """How often a rule finds something in documents, which are no source code, in SQL."""
    worth = " OR ".join(f"contains(lower(content), '{w}')" for w in rule.words)
    pattern = rule.pattern.replace("'", "''")
    if not rule.assigned:
        return f"CASE WHEN {worth} THEN len(regexp_extract_all(content, '{pattern}')) ELSE 0 END"
    plain = "trim(lower(x), '\"''`<>[]')"
    names = ", ".join(f"'{p}'" for p in Y.PLACEHOLDERS)
    holder = f"({plain} IN ({names}) OR starts_with({plain}, 'your_') OR starts_with({plain}, 'your-') OR regexp_matches({plain}, '{Y._EXPRESSION}'))"
    return f"CASE WHEN {worth} THEN len(list_filter(regexp_extract_all(content, '{pattern}', 1), lambda x: NOT {holder})) ELSE 0 END"


_COUNTS = ", ".join(f"{_count(r)} AS c{i}" for i, r in enumerate(Y.RULES))
_IDS = ", ".join(f"CASE WHEN c{i} > 0 THEN '{r.name}' END" for i, r in enumerate(Y.RULES))


@query("secret_screen", f"""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path, text AS content FROM documents), c AS (SELECT path, content, {_COUNTS} FROM f)
SELECT path, CASE WHEN content IS NULL OR octet_length(encode(content)) > 4194304 THEN 'indeterminate' WHEN c0 + c1 + c2 + c3 + c4 > 0 THEN 'sensitive' ELSE 'clean' END AS state, array_to_string(list_filter([{_IDS}], lambda x: x IS NOT NULL), ',') AS rule_ids, coalesce(c0 + c1 + c2 + c3 + c4, 0) AS findings, (content IS NULL OR octet_length(encode(content)) > 4194304 OR c0 + c1 + c2 + c3 + c4 > 0) AS withheld FROM c""")
def secret_screen(spark, d):
    docs = T.table(spark, d, "documents")
    return Y.screen(docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))


@query("structural_checks", f"""{_SQL} SELECT path, 'check!("}}", LIMIT_' || k || ')' AS code, '"}}"' AS first, 'LIMIT_' || k AS second FROM l WHERE lang = 0""")
def structural_checks(spark, d):
    met = X.structural(sources(spark, d), "check!($FIRST, $SECOND)", "rust")
    return met.select("path", "code", F.col("captures")["FIRST"].alias("first"), F.col("captures")["SECOND"].alias("second"))

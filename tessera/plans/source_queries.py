"""Source files written from the tables, read again by the extractors; changes between two versions of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import impact as I, sourcecode as S, symbolviews as W
from tessera.plans.registry import query
from tessera.scratch import cut
from tessera.sources import tables as T

#: A file for each order: its language by its key, a method for each of its lines.
_HEAD = {
    "rust": ("use crate::store::{Stock, supplier_@s@ as first};\n/* order @k@ } */\nconst LIMIT_@k@: u32 = 7;\nstruct Order_@k@ { count: u32 }\nimpl Stock for Order_@k@ {\n", "    fn line_@n@(&self) -> Part { check!(\"}\", LIMIT_@k@); part_@p@(1) }\n", "}\n", "rs"),
    "python": ("import store.supplier_@s@ as first\nfrom store import Stock\n# order @k@ )\nLIMIT_@k@ = 7\nclass Order_@k@(Stock):\n", "    def line_@n@(self) -> Part:\n        return part_@p@(\")\", LIMIT_@k@)\n", "", "py"),
    "typescript": ("import { Stock, supplier_@s@ as first } from 'store';\n// order @k@ }\nconst LIMIT_@k@: number = 7;\nclass Order_@k@ implements Stock {\n", "  line_@n@(): Part { return part_@p@(`}`, LIMIT_@k@); }\n", "}\n", "ts"),
    "java": ("import store.Stock;\nimport store.supplier_@s@;\nclass Order_@k@ implements Stock {\n  static final int LIMIT_@k@ = 7;\n", "  Part line_@n@() { return part_@p@('}', LIMIT_@k@); }\n", "}\n", "java"),
    "go": ("package orders\nimport (\n  first \"store/supplier_@s@\"\n  \"store\"\n)\nconst LIMIT_@k@ = 7\ntype Order_@k@ struct { count int }\n", "func (o *Order_@k@) line_@n@() Part { return part_@p@(\"}\", LIMIT_@k@) }\n", "", "go"),
}
_LANGUAGES = list(_HEAD)


def _filled(text, **columns):
    out = text
    for name, c in columns.items():
        out = F.replace(out, F.lit(f"@{name}@"), c.cast("string"))
    return out


def _parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def sources(spark, d):
    """(path, language, content) of all orders; those with status P break off in a call."""
    lines = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("l"))
    # parsing takes far longer than reading, so partitions stay as small as asked for
    per = lines.repartition(_parts(spark), "k").groupBy("k").agg(F.sort_array(F.collect_list("l")).alias("l"))
    orders = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus").join(per, "k")
    pick = lambda i: F.element_at(F.array(*[F.lit(_HEAD[x][i]) for x in _LANGUAGES]), (F.col("k") % 5 + 1).cast("int"))
    body = F.array_join(F.transform("l", lambda x: _filled(pick(1), n=x["l_linenumber"], p=x["l_partkey"], k=F.col("k"))), "")
    head = _filled(pick(0), s=F.col("l")[0]["l_suppkey"], k=F.col("k"))
    tail = F.when(F.col("o_orderstatus") == "P", "\ntail(").otherwise("")
    path = F.concat(F.lit("orders/"), F.col("k").cast("string"), F.lit("."), pick(3))
    return orders.select(path.alias("path"), S.language_of(path).alias("language"), F.concat(head, body, pick(2), tail).alias("content"))


_SQL = """WITH f AS (SELECT k, st, s, k % 5 AS lang, 'orders/' || k || '.' || ['rs', 'py', 'ts', 'java', 'go'][k % 5 + 1] AS path FROM (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders) JOIN (SELECT l_orderkey AS k, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}).s AS s FROM lineitem GROUP BY 1) USING (k)),
l AS (SELECT f.*, l_linenumber AS n, l_partkey AS p FROM f JOIN lineitem ON l_orderkey = k)"""


@query("source_symbols", f"""{_SQL} SELECT path, 'LIMIT_' || k AS name, 'constant' AS kind, CASE lang WHEN 3 THEN 1 ELSE 0 END AS depth FROM f
UNION ALL SELECT path, 'Order_' || k, CASE WHEN lang IN (0, 4) THEN 'struct' ELSE 'class' END, 0 FROM f
UNION ALL SELECT path, 'impl Stock for Order_' || k, 'impl', 0 FROM f WHERE lang = 0
UNION ALL SELECT path, 'line_' || n, 'method', CASE lang WHEN 4 THEN 0 ELSE 1 END FROM l""")
def source_symbols(spark, d):
    return S.symbols(S.extract(sources(spark, d), records=["symbol"])).select("path", "name", "kind", "depth")


@query("source_references", f"""{_SQL} SELECT path, CASE lang WHEN 0 THEN 'crate::store::supplier_' || s WHEN 1 THEN 'store.supplier_' || s WHEN 2 THEN 'supplier_' || s WHEN 3 THEN 'store.supplier_' || s ELSE 'store/supplier_' || s END AS name, 'import' AS kind, NULL AS target FROM f
UNION ALL SELECT path, CASE lang WHEN 0 THEN 'crate::store::Stock' WHEN 2 THEN 'Stock' WHEN 4 THEN 'store' ELSE 'store.Stock' END, 'import', NULL FROM f
UNION ALL SELECT path, 'store', 'import', NULL FROM f WHERE lang IN (1, 2)
UNION ALL SELECT path, 'Stock', 'implements', 'Order_' || k FROM f WHERE lang <> 4
UNION ALL SELECT path, 'Part', 'type', NULL FROM l
UNION ALL SELECT path, 'part_' || p, 'call', NULL FROM l
UNION ALL SELECT path, 'LIMIT_' || k, 'value', NULL FROM l
UNION ALL SELECT path, 'check', 'macro', NULL FROM l WHERE lang = 0
UNION ALL SELECT path, 'tail', 'call', NULL FROM f WHERE st = 'P'""")
def source_references(spark, d):
    return S.references(S.extract(sources(spark, d), records=["reference"], columns=["name", "kind", "target"])).select("path", "name", "kind", "target")


@query("source_aliases", f"""{_SQL} SELECT path, 'first' AS alias, CASE lang WHEN 0 THEN 'crate::store::supplier_' || s WHEN 1 THEN 'store.supplier_' || s WHEN 2 THEN 'supplier_' || s ELSE 'store/supplier_' || s END AS original FROM f WHERE lang <> 3""")
def source_aliases(spark, d):
    return S.aliases(S.extract(sources(spark, d), records=["alias"]))


@query("source_status", f"""{_SQL} SELECT path, ['rust', 'python', 'typescript', 'java', 'go'][lang + 1] AS language, CASE st WHEN 'P' THEN 'partial' ELSE 'processed' END AS status, CASE st WHEN 'P' THEN '( isn''t closed' END AS problem FROM f""")
def source_status(spark, d):
    return S.status(S.extract(sources(spark, d), records=["status"])).select("path", "language", "status", "problem")


@query("source_callers", f"""{_SQL} SELECT path, 'line_' || n AS caller, 'part_' || p AS called, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT path, NULL, 'tail', count(*) FROM f WHERE st = 'P' AND lang <> 1 GROUP BY path UNION ALL SELECT path, NULL, 'tail', 1 FROM f WHERE st = 'P' AND lang = 1""")
def source_callers(spark, d):
    # a reference knows the symbol around it
    facts = S.extract(sources(spark, d), records=["reference"], columns=["name", "kind", "around"])
    calls = S.references(facts).where("kind = 'call'")
    return calls.groupBy("path", F.col("around").alias("caller"), F.col("name").alias("called")).agg(F.count("*").alias("n"))


def pages(spark, d):
    return T.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))


@query("page_references", """SELECT CAST(page_id AS VARCHAR) AS path, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS name, 'value' AS kind FROM pages""")
def page_references(spark, d):
    return S.references(S.extract(pages(spark, d))).select("path", "name", "kind")


@query("page_status", """SELECT CAST(page_id AS VARCHAR) AS path, 'html' AS language, CASE WHEN html IS NULL THEN 'failed' WHEN len(regexp_extract_all(html, '<(?:div|article|nav|ul|b|a|script|style|footer|table|span|section|aside|main|header|title|h1|h2|h3|pre|code|em|i|strong|form)[ >]')) = len(regexp_extract_all(html, '</(?:div|article|nav|ul|b|a|script|style|footer|table|span|section|aside|main|header|title|h1|h2|h3|pre|code|em|i|strong|form)>')) THEN 'processed' ELSE 'partial' END AS status FROM pages""")
def page_status(spark, d):
    return S.status(S.extract(pages(spark, d))).select("path", "language", "status")


def versions(spark, d):
    """Two versions of a program: a function for each part, order and customer, and an entry for each nation.

    Orders call their parts, customers their orders, entries the parts that fall
    to them. In the new version every part has another first line, and larger
    parts (above size 45) another body.
    """
    parts = T.table(spark, d, "part").select("p_partkey", "p_size")
    items = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))
    # dealt out once: a key's set leaves out its repeated pairs
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    at = lambda head, key, tail: F.concat(F.lit(head), text(F.col(key)), F.lit(tail))

    def called(rows, key, name):
        begin = "part_" if name == "p" else "order_"
        return rows.repartition(_parts(spark), key).groupBy(key).agg(F.collect_set(name).alias("_set")).select(key, F.when(F.size("_set") == 0, "").otherwise(F.concat(F.lit(begin), F.array_join(F.sort_array("_set").cast("array<string>"), f"(n) + {begin}"), F.lit("(n)"))).alias("calls"))

    orders = called(items, "k", "p").select(at("orders/", "k", ".py").alias("path"), F.lit("python").alias("language"), F.concat(at("def order_", "k", "(n):\n    return "), "calls", F.lit("\n")).alias("content"))
    held = T.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    customers = called(held, "c", "k").select(at("customers/", "c", ".go").alias("path"), F.lit("go").alias("language"), F.concat(at("package main\n\nfunc customer_", "c", "(n int) int {\n\treturn "), "calls", F.lit("\n}\n")).alias("content"))
    mains = called(parts.select((F.col("p_partkey") % 25).alias("n"), F.col("p_partkey").alias("p")), "n", "p").select(at("nations/", "n", ".rs").alias("path"), F.lit("rust").alias("language"), F.concat(F.lit("fn main() {\n    let n = 1;\n    "), "calls", F.lit(";\n}\n")).alias("content"))
    # both versions and each later step read these files, so they are written once
    same = cut(orders.unionByName(customers).unionByName(mains), "unchanged")

    def of(head, size):
        own = parts.repartition(_parts(spark), "p_partkey")
        return same.unionByName(own.select(at("parts/", "p_partkey", ".ts").alias("path"), F.lit("typescript").alias("language"), F.concat(at(f"{head}export function part_", "p_partkey", "(n: number): number {\n  return n + "), text(size), F.lit(";\n}\n")).alias("content")))

    return of("", F.col("p_size").cast("long")), of("// moved\n\n", F.when(F.col("p_size") > 45, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("long"))


_IMPACT = """WITH ch AS (SELECT p_partkey AS p FROM part WHERE p_size > 45), o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey IN (SELECT p FROM ch)),
c AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey IN (SELECT k FROM o)),
blast AS (SELECT 'orders/' || k || '.py::order_' || k AS symbol, 1::BIGINT AS hop, 'high' AS risk FROM o UNION ALL SELECT DISTINCT 'nations/' || (p % 25) || '.rs::main', 1, 'critical' FROM ch UNION ALL SELECT 'customers/' || c || '.go::customer_' || c, 2, 'medium' FROM c)"""


def _impact(spark, d, **asked):
    old, new = versions(spark, d)
    return I.impact(old, new, I.options(["main"], **asked))


@query("impact_symbols", "SELECT 'parts/' || p_partkey || '.ts' AS path, 'part_' || p_partkey AS name, 'function' AS kind, 'changed' AS change, 1::BIGINT AS old_line, 3::BIGINT AS new_line FROM part WHERE p_size > 45")
def impact_symbols(spark, d):
    return _impact(spark, d, depth=0).symbols


@query("impact_blast", f"{_IMPACT} SELECT symbol, hop, risk FROM blast")
def impact_blast(spark, d):
    return _impact(spark, d).blast


@query("impact_files", f"{_IMPACT} SELECT split_part(symbol, '::', 1) AS symbol, hop, risk FROM blast")
def impact_files(spark, d):
    return _impact(spark, d, scope="files").blast


@query("impact_report", f"""{_IMPACT} SELECT symbol, hop, risk FROM blast ORDER BY CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, hop, symbol LIMIT 200""")
def impact_report(spark, d):
    return _impact(spark, d).shown_blast()


@query("impact_counts", f"""{_IMPACT}, n AS (SELECT 'changed_files' AS list, (SELECT count(*) FROM part) AS total UNION ALL SELECT 'changed_symbols', (SELECT count(*) FROM ch) UNION ALL SELECT 'blast_radius', (SELECT count(*) FROM blast))
SELECT list, total, least(total, 200) AS returned, total > 200 AS truncated FROM n
UNION ALL SELECT 'risk:' || r, (SELECT count(*) FROM blast WHERE risk = r), NULL, false FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS r)""")
def impact_counts(spark, d):
    return _impact(spark, d).counts()


def _asked(facts, only=None):
    """A request for each function of the program (or of some files), named path::name."""
    own = S.symbols(facts).where("kind = 'function'")
    own = own if only is None else own.where(only)
    # dealt out as the symbols that they meet
    return own.select(I.node().alias("request"), "path", "name", "kind", F.lit(None).cast("int").alias("line")).repartition("path", "name").distinct()


_CALLS = """WITH o AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), h AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS k FROM orders), u AS (SELECT DISTINCT k FROM o),
e AS (SELECT 'orders/' || k || '.py::order_' || k AS request, 'callees' AS section, 'part_' || p AS name FROM o UNION ALL SELECT 'customers/' || c || '.go::customer_' || c, 'callees', 'order_' || k FROM h UNION ALL SELECT 'nations/' || (p_partkey % 25) || '.rs::main', 'callees', 'part_' || p_partkey FROM part
UNION ALL SELECT 'parts/' || p || '.ts::part_' || p, 'callers', 'part_' || p FROM o WHERE p IN (SELECT p_partkey FROM part) UNION ALL SELECT 'parts/' || p_partkey || '.ts::part_' || p_partkey, 'callers', 'part_' || p_partkey FROM part UNION ALL SELECT 'orders/' || k || '.py::order_' || k, 'callers', 'order_' || k FROM h JOIN u USING (k))"""


@query("symbol_totals", f"""{_CALLS} SELECT request, section, count(*) AS total, count(DISTINCT name) AS names, greatest(count(*) - 20, 0) AS overflow FROM e GROUP BY request, section""")
def symbol_totals(spark, d):
    program = versions(spark, d)[1]
    facts = cut(S.extract(program, records=["symbol", "reference"], columns=["ordinal", "name", "kind", "depth", "enclosing", "qualified"]), "facts")
    return W.totals(W.entries(_asked(facts), facts, program, sections=("callers", "callees", "siblings")))


@query("symbol_bundles", """WITH c AS (SELECT DISTINCT l_partkey AS p, 'orders/' || l_orderkey || '.py' AS path, 2 AS line, 'in function order_' || l_orderkey AS detail FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, 'nations/' || (p_partkey % 25) || '.rs', 3, 'in function main' FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY path, line) AS nth FROM c)
SELECT 'parts/' || p || '.ts::part_' || p AS request, 'callers' AS section, nth, 'part_' || p AS name, path, line, detail FROM n WHERE nth <= 20
UNION ALL SELECT 'parts/' || p_partkey || '.ts::part_' || p_partkey, 'body', 1, 'part_' || p_partkey, 'parts/' || p_partkey || '.ts', 3, 'function part_' || p_partkey || '(n: number): number {' || chr(10) || '  return n + ' || CASE WHEN p_size > 45 THEN p_size + 1 ELSE p_size END || ';' || chr(10) || '}' FROM part""")
def symbol_bundles(spark, d):
    program = versions(spark, d)[1]
    facts = cut(S.extract(program, records=["symbol", "reference"], columns=["name", "kind", "first_line", "start", "stop", "qualified", "around", "around_kind"]), "facts")
    every = W.entries(_asked(facts, F.col("path").startswith("parts/")), facts, program, sections=("body", "callers"))
    return W.shown(every).select("request", "section", "nth", "name", "path", "line", "detail")

"""File search by signals: tiers, partners of the file at hand, recent reads; hints resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import filerank as K
from tessera.plans.history_queries import _FREC, _stats
from tessera.plans.registry import query
from tessera.sources import tables as T


def _files(spark, d):
    """Documents as files; every seventh of them is known by its metadata only."""
    docs = T.table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(path.alias("path"), F.when(F.col("doc_id") % 7 == 3, "binary").alias("metadata_reason"))


_PATHS = """WITH files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, lower(source || '/' || lang || '/' || doc_id || '.txt') AS low, doc_id || '.txt' AS last, CAST(doc_id AS VARCHAR) AS stem, CASE WHEN doc_id % 7 = 3 THEN 'binary' END AS metadata_reason, source, lang FROM documents)"""
#: Tiers of the query 'en/10': folder en, last part 10, too short for a prefix.
_TIERS = f"""{_PATHS}, m AS (SELECT *, CASE WHEN low LIKE '%en/10' OR (last = '10' AND (source = 'en' OR lang = 'en')) THEN 1000.0 WHEN last = '10' THEN 100.0 WHEN contains(low, 'en') AND contains(low, '10') THEN 10.0 ELSE 0.0 END AS score FROM files)"""


@query("file_search", f"""{_TIERS}, r AS (SELECT path, CASE WHEN metadata_reason IS NOT NULL THEN 'metadata_only' WHEN score = 1000 THEN 'strong' WHEN score = 100 THEN 'basename' ELSE 'loose' END AS tier, score, metadata_reason, row_number() OVER (ORDER BY metadata_reason IS NOT NULL, score DESC, source = 'src1' AND lang = 'en' DESC, source = 'src1' DESC, strlen(path), path) AS place, count(*) OVER () AS total FROM m WHERE score > 0)
SELECT place, path, tier, CAST(score AS DOUBLE) AS score, metadata_reason, total, greatest(total - 20, 0) AS overflow FROM r WHERE place <= 20""")
def file_search(spark, d):
    found, _ = K.ranked(_files(spark, d), "en/10", anchor="src1/en/4.txt")
    return K.first(found).drop("coupling", "shared", "evidence")


_COUPLED = """c AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars % 5 AS shared, CAST(n_chars % 11 AS DOUBLE) AS weight FROM documents WHERE doc_id % 3 <> 1)"""


def _partners(spark, d):
    docs = T.table(spark, d, "documents").where("doc_id % 3 <> 1")
    path = F.concat_ws("/", "source", F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(path.alias("path"), (F.col("n_chars") % 5).alias("shared"), (F.col("n_chars") % 11).cast("double").alias("weight"))


@query("file_search_co_change", f"""{_PATHS}, {_COUPLED}, m AS (SELECT files.*, shared, weight, CASE WHEN contains(low, 'en') AND contains(low, 'txt') THEN 10.0 ELSE 0.0 END AS match FROM files LEFT JOIN c USING (path)),
r AS (SELECT *, match AS score, row_number() OVER (ORDER BY metadata_reason IS NOT NULL, match DESC, strlen(path), path) AS place, count(*) OVER () AS total FROM m WHERE match > 0)
SELECT place, path, CASE WHEN metadata_reason IS NOT NULL THEN 'metadata_only' ELSE 'loose' END AS tier, CAST(score AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS coupling, CAST(NULL AS BIGINT) AS shared, total, greatest(total - 50, 0) AS overflow FROM r WHERE place <= 50""")
def file_search_co_change(spark, d):
    """The file at hand doesn't match the query, so the order is that of the tiers."""
    found, _ = K.ranked(_files(spark, d), "en txt", anchor="notes.md", coupling=_partners(spark, d), rank_by="path+cochange")
    return K.first(found, 50).drop("metadata_reason", "evidence")


@query("file_search_partners", f"""{_PATHS}, {_COUPLED}, m AS (SELECT files.*, shared, weight, max(weight) OVER () AS most FROM files LEFT JOIN c USING (path) WHERE contains(low, '/') AND contains(low, '.txt')),
s AS (SELECT *, metadata_reason IS NULL AND shared >= 2 AND weight > 0 AS lifted, CASE WHEN shared >= 2 AND weight > 0 THEN weight ELSE 0 END AS gain FROM m),
r AS (SELECT *, 10.0 + gain AS score, row_number() OVER (ORDER BY metadata_reason IS NOT NULL, gain DESC, strlen(path), path) AS place, count(*) OVER () AS total FROM s)
SELECT place, path, CASE WHEN metadata_reason IS NOT NULL THEN 'metadata_only' WHEN lifted THEN 'co_change' ELSE 'loose' END AS tier, CAST(score AS DOUBLE) AS score, CASE WHEN lifted THEN weight / most END AS coupling, CASE WHEN lifted THEN shared END AS shared, total, greatest(total - 50, 0) AS overflow FROM r WHERE place <= 50""")
def file_search_partners(spark, d):
    found, _ = K.ranked(_files(spark, d), ".txt", anchor="docs/.txt", coupling=_partners(spark, d), rank_by="path+cochange")
    return K.first(found, 50).drop("metadata_reason", "evidence")


@query("file_search_frecency", f"""WITH s AS (SELECT path, frecency FROM ({_FREC})), f AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 3 THEN 'binary' END AS metadata_reason FROM documents WHERE contains(CAST(doc_id AS VARCHAR), '1')),
m AS (SELECT f.*, CASE WHEN path = '1' THEN 'strong' ELSE 'loose' END AS own, least(greatest(coalesce(frecency, 0) / (SELECT max(frecency) FROM s), 0), 1) AS share FROM f LEFT JOIN s USING (path)),
r AS (SELECT path, CASE WHEN metadata_reason IS NOT NULL THEN 'metadata_only' ELSE own END AS tier, round(CAST(0.6 AS DOUBLE) * CASE WHEN metadata_reason IS NOT NULL THEN 0 WHEN own = 'strong' THEN 1.0 ELSE 0.3 END + CAST(0.1 AS DOUBLE) * share, 6) AS score FROM m),
n AS (SELECT *, row_number() OVER (ORDER BY tier = 'metadata_only', score DESC, path) AS place, count(*) OVER () AS total FROM r)
SELECT place, path, tier, score, total, greatest(total - 50, 0) AS overflow FROM n WHERE place <= 50""")
def file_search_frecency(spark, d):
    docs = T.table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 3, "binary").alias("metadata_reason"))
    found, _ = K.ranked(files, "1", frecency=_stats(spark, d), rank_by="frecency")
    return K.first(found.withColumn("score", F.round("score", 6)), 50).drop("coupling", "shared", "metadata_reason", "evidence")


@query("path_candidates", f"""{_PATHS}, r AS (SELECT path, row_number() OVER (ORDER BY strlen(path), path) AS nth, count(*) OVER () AS n FROM files WHERE metadata_reason IS NULL AND lang = 'en' AND contains(low, 'en/1'))
SELECT 'ambiguous' AS status, nth, path, greatest(n - 10, 0) AS overflow FROM r WHERE nth <= 10""")
def path_candidates(spark, d):
    return K.resolve(_files(spark, d), "./en/1")

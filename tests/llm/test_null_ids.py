"""Documents without an id go through the pipeline like others."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_keeps_rows_without_id(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (None, text, "en", "s", len(text)), (None, text, "en", "s", len(text)), (3, "other " * 20, "en", "s", 120)]
    out = pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert out.columns == list(pipeline.COLUMNS)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, text), (0, text), (1, text), (3, "other " * 20)])


def test_null_id_reaches_the_end(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(path + "/documents.parquet").select(*pipeline.COLUMNS)
    good = spark.read.parquet(path + "/labels.parquet").where("quality = 1").select("doc_id")
    some = docs.join(good, "doc_id", "left_semi").orderBy("doc_id").limit(5)
    nameless = some.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('Nameless. ', text) AS text", "lang", "source", "n_chars")
    now, counts = docs.unionByName(nameless).cache(), []
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, path).cache()
        counts.append(now.where("doc_id IS NULL").select("text" if "text" in now.columns else "sequence_id").count())
    assert counts[0] > 0 and counts[1:4] == [counts[0]] * 3 and counts[4] >= counts[0]

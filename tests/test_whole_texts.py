"""Gram upkeep and search over whole texts against plain versions."""

from collections import Counter

from pyspark.sql import functions as F

import tessera.plans  # noqa: F401
from tessera.operators import search as S
from tessera.plans.registry import QUERIES
from tessera.sources import tables as T

DATA = "/root/testdata/sf0.001"


def grams(text: str) -> set:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def test_grams_of_odd_and_long_texts(spark):
    texts = [None, "", "ab", "aBc", "a\U0001f600é\n日本", "   ", "aaaa", "x.y*|\\", "line " * 40000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.trigrams(F.col("text")).alias("g")).collect()
    for r in rows:
        assert sorted(r.g) == sorted(grams((r.text or "").lower()))


def test_texts(spark):
    docs = T.files(spark, DATA).select("doc_id", "content", F.lower("content").alias("low")).collect()
    assert max(len(r.content) for r in docs) > 1000
    want = Counter()
    for r in docs:
        if r.doc_id % 10 != 2:
            want.update(grams(("new text " if r.doc_id % 10 == 1 else "") + r.low))
    assert {r.gram: r.n for r in QUERIES["trigram_update_texts"](spark, DATA).collect()} == want
    found = {(r.id, r.text) for r in QUERIES["trigram_search_texts"](spark, DATA).collect()}
    assert found == {(r.doc_id, r.content) for r in docs if "license" in r.low} and found

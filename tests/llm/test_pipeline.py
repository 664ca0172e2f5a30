"""Each pipeline stage against a plain version of what it is to keep."""

import numpy as np

import corpus_pipeline as pipeline
from tessera.llm import quality, secrets

from test_operators import components, repeats


def test_stages(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    before = spark.read.parquet(path + "/documents.parquet").cache()
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    tables = []
    for _, stage in pipeline.STAGES:
        before = stage(spark, before, path).cache()
        tables.append(before.collect())
    source = {r.doc_id: r.text for r in spark.read.parquet(path + "/documents.parquet").collect()}
    kept = {r.doc_id: r.text for r in tables[0]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(path + "/labels.parquet").collect()}
    assert all(source[i] == t for i, t in kept.items())
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.95
    unique = {r.doc_id: r.text for r in tables[1]}
    found = components(list(kept.items()), 5, 4, 5)
    assert set(unique) == {i for i, (_, c) in found.items() if i == c}
    cut = {r.doc_id: r.text for r in tables[2]}
    plain = repeats(list(unique.items()), 100)
    for i, t in unique.items():
        n, gone, _, _ = plain[i]
        assert (i not in cut) == (n > 0 and n == gone)
        if not gone:
            assert cut[i] == t
        elif i in cut:
            assert n - gone - 8 * plain[i][2] <= len(cut[i].encode()) <= n - gone
    clean = {r.doc_id: r.text for r in tables[3]}
    assert clean == {i: secrets.redacted(t, secrets.all_spans(t)[1]) for i, t in cut.items()}
    assert {r.doc_id for r in tables[4]} == set(clean)
    assert quality.THRESHOLD == 0.3

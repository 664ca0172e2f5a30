"""Templates of more k-grams than a mask's word has bits, and templates too short."""

import random

import pytest

from tessera.llm import licenses


@pytest.mark.parametrize("size", [64, 65, 66, 128, 129, 400])
def test_long_passage(spark, size):
    r = random.Random(size)
    words = [f"w{i}" for i in range(size)]
    part = words[: size // 2]
    inserted = [*words[: size // 3], "new", *words[size // 3 :]]
    texts = [" ".join(words), "before " + " ".join(inserted) + " after", " ".join(part), " ".join(r.sample(words, size))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in licenses.scan(docs, phrases={}, passages={" ".join(words): "long"}).collect()}
    grams = size - licenses.K + 1
    assert [rows[i].labels for i in range(4)] == ["long", "long", "", ""]
    assert rows[0].score == 1.0
    assert rows[1].score == pytest.approx((grams - licenses.K + 1) / grams)
    assert rows[2].score == pytest.approx((len(part) - licenses.K + 1) / grams)


def test_too_short(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    for given in ({"phrases": {"cc by": "cc"}}, {"passages": {"gpl": "gpl"}}):
        with pytest.raises(ValueError, match="at least 3 words"):
            licenses.scan(docs, **given)

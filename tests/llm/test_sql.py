"""Corpus queries with SQL give that SQL's rows on whole tables."""

import pytest

import __spark_entry__

from test_oracles import DATA, canonical, duck  # noqa: F401


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op2_chat_windows", "op3_suffix_dedup", "op11_importance_resampling"])
def test_same_rows(spark, duck, name):  # noqa: F811
    got = canonical(__spark_entry__.queries()[name](spark, DATA).toPandas())
    want = canonical(duck.sql(__spark_entry__.oracle_sql()[name]).df())
    assert len(got) and got.equals(want)

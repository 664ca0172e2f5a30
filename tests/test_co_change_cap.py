"""The cap on files of a commit, on few commits; the query's own cap is 50."""

from tessera.operators import history as H
from tessera.plans.registry import QUERIES

import tessera.plans  # noqa: F401


def test_small_cap(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, "a"), (4, "c")]
    log = spark.createDataFrame(rows, "oid long, path string")
    found = lambda **k: {(r.a, r.b): (r.shared, r.na, r.nb, r.jaccard) for r in H.co_change(log, least=0.0, **k).collect()}
    assert found() == {("a", "b"): (3, 4, 3, 0.75), ("a", "c"): (2, 4, 2, 0.5)}
    assert found(most_files=2) == {("a", "b"): (2, 4, 3, 0.4)}


def test_query_takes_commits_of_seven_files(spark, tmp_path):
    parts = spark.createDataFrame([(i, f"T{i}", "B") for i in range(7)], "p_partkey long, p_type string, p_brand string")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT o.id AS l_orderkey, p.id AS l_partkey FROM range(2) o CROSS JOIN range(7) p").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, timestamp'2000-01-01' AS o_orderdate, id AS o_custkey FROM range(2)").write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES["co_change_jaccard"](spark, str(tmp_path)).collect()
    assert len(rows) == 21 and {(r.shared, r.jaccard) for r in rows} == {(2, 1.0)}

"""Queries held against their SQL without the cuts that the registered SQL has.

The registered SQL still takes part of the rows, so ``test_oracles`` differs from
these queries. CUTS has what to leave out of it, by query.
"""

import os

import duckdb
import pandas as pd
import pytest

import tessera.plans  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

from test_oracles import DATA, TABLES, canonical

EDGES = [" AND x.l_orderkey % 7 = 0"]
CUTS = dict.fromkeys("call_graph top_in_degree blast_radius evict_dead graph_export_dot graph_export_mermaid impact_summary reexport_dependents type_dependencies unseen_callees gated_symbol_edges co_change_gate".split(), EDGES)
CUTS |= {
    "hunk_symbols": [" WHERE l_orderkey % 25 = 0"],
    "references_in_symbol": [" WHERE p_partkey % 5 = 0", " WHERE p_size % 3 = 0"],
    "outside_test_modules": [" WHERE p_partkey % 5 = 0"],
}
CUTS |= dict.fromkeys(["inspect_match", "enclosing_symbol", "hits_by_symbol"], [" WHERE p_partkey % 3 = 0"]) | {"innermost_symbol": [" WHERE p_partkey % 5 = 0"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(CUTS))
def test_all_rows(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    sql = ORACLE_SQL[name]
    for cut in CUTS[name]:
        sql = sql.replace(cut, "")
    got, want = canonical(QUERIES[name](spark, DATA).toPandas()), canonical(con.sql(sql).df())
    for f in (got, want):  # integers that a null made floats
        for c in f.columns:
            f[c] = f[c].str.removesuffix(".0")
    got, want = (f.sort_values(list(f.columns)).reset_index(drop=True) for f in (got, want))
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)

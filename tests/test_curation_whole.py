"""curation_preview over all orders against a plain version."""

import pandas as pd

import tessera.plans  # noqa: F401
from tessera.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"


def test_every_order_is_an_edit(spark):
    brands = dict(pd.read_parquet(f"{DATA}/part.parquet", columns=["p_partkey", "p_brand"]).itertuples(index=False))
    keys = pd.read_parquet(f"{DATA}/orders.parquet", columns=["o_orderkey"]).o_orderkey.tolist()
    first = {}
    for k in keys:
        first[k % 2000] = min(first.get(k % 2000, f"k{k}"), f"k{k}")
    want = {}
    for k in keys:
        place = k % 2000
        op, now = "remove" if k % 4 == 0 else "upsert", brands.get(place)
        asked = "x" if k % 3 == 0 else now
        outcome = "conflict" if first[place] != f"k{k}" else "missing" if op == "remove" and now is None else "stale" if asked != now else "applied"
        want[f"k{k}"] = (str(place), op, outcome)
    rows = QUERIES["curation_preview"](spark, DATA).collect()
    assert len(rows) == len(keys)
    assert {r["key"]: (r.path, r.op, r.outcome) for r in rows} == want
    assert {o for _, _, o in want.values()} >= {"conflict", "stale", "applied"}

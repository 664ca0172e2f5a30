"""Ranked file search: tiers, partners, fallbacks, recent reads; hints resolved."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import filerank as K
from tessera.operators.search import InvalidQuery

ROUTES = ["src/auth/routes.rs", "src/server/routes.rs", "src/routes/mod.rs", "src/server/router.rs", "docs/routes.md"]


def files(spark, paths, meta=()):
    return spark.createDataFrame([(p, None) for p in paths] + [(p, "binary") for p in meta], "path string, metadata_reason string")


def coupling(spark, **by):
    return spark.createDataFrame([(p.replace("__", "/").replace("_rs", ".rs"), *v) for p, v in by.items()], "path string, shared long, weight double")


def search(spark, query, paths=ROUTES, meta=(), limit=10, **kw):
    found, missing = K.ranked(files(spark, paths, meta), query, **kw)
    return [(r.path, r.tier, r.coupling, r.shared) for r in K.first(found, limit).orderBy("place").collect()], missing


def test_partner_is_promoted_above_the_floor(spark):
    base, _ = search(spark, "routes.rs")
    assert base == [("src/auth/routes.rs", "basename", None, None), ("src/server/routes.rs", "basename", None, None)]
    got, missing = search(spark, "routes.rs", anchor="src/auth/routes.rs", coupling=coupling(spark, src__server__routes_rs=(2, 9.0)), rank_by="path+cochange")
    assert got[0] == ("src/server/routes.rs", "co_change", 1.0, 2) and missing == {}


def test_below_the_floor_nothing_changes(spark):
    base, _ = search(spark, "routes.rs", anchor="src/auth/routes.rs")
    for pair in ((1, 900.0), (9, 0.0), (9, float("nan")), (9, float("inf")), (9, -1.0)):
        got, _ = search(spark, "routes.rs", anchor="src/auth/routes.rs", coupling=coupling(spark, src__server__routes_rs=pair), rank_by="path+cochange")
        assert got == base


def test_weak_anchor_falls_back(spark):
    near = coupling(spark, src__server__routes_rs=(4, 9.0))
    base, _ = search(spark, "rou", anchor="src/auth/routes.rs")
    got, missing = search(spark, "rou", anchor="src/auth/routes.rs", coupling=near, rank_by="path+cochange")
    assert got == base and missing == {"co_change": "the file at hand doesn't match the query"}
    _, missing = search(spark, "Cargo.lock", anchor="a/Cargo.lock", coupling=near, rank_by="path+cochange", paths=["a/Cargo.lock"])
    assert missing == {"co_change": "the file at hand changes with everything"}
    _, missing = search(spark, "routes.rs", anchor="src/auth/routes.rs", rank_by="path+cochange")
    assert missing == {"co_change": "no history of changes"}


def test_tiny_weights_and_unmatched_neighbours(spark):
    got, _ = search(spark, "routes.rs", anchor="src/auth/routes.rs", coupling=coupling(spark, src__server__routes_rs=(2, 0.000_001)), rank_by="path+cochange")
    assert ("src/server/routes.rs", "co_change", 1.0, 2) in got
    base, _ = search(spark, "routes.rs", anchor="src/auth/routes.rs")
    got, _ = search(spark, "routes.rs", anchor="src/auth/routes.rs", coupling=coupling(spark, src__other__routes_rs=(9, 100.0)), rank_by="path+cochange")
    assert got == base


def test_tier_order_without_context(spark):
    paths = ["src/tools.rs", "src/protocol/tools.rs", "src/protocol/toolset.rs", "lib/my_tools.rs", "src/tools.rs.bak/x"]
    got, missing = search(spark, "tools.rs", paths=paths, meta=["bin/tools.rs"])
    assert [g[:2] for g in got] == [("src/tools.rs", "basename"), ("src/protocol/tools.rs", "basename"), ("lib/my_tools.rs", "loose"), ("src/tools.rs.bak/x", "loose"), ("bin/tools.rs", "metadata_only")] and missing == {}
    got, _ = search(spark, "protocol/tools.rs", paths=paths)
    assert got[0][:2] == ("src/protocol/tools.rs", "strong")
    got, _ = search(spark, "TOO", paths=paths)
    assert [g[0] for g in got] == ["src/tools.rs", "src/protocol/tools.rs", "src/protocol/toolset.rs", "lib/my_tools.rs", "src/tools.rs.bak/x"]
    got, _ = search(spark, "to", paths=["a/to", "src/b/to", "src/b/c/to"], anchor="src/b/x.rs")
    assert [g[0] for g in got] == ["src/b/to", "src/b/c/to", "a/to"]
    got, _ = search(spark, "src tools", paths=paths)
    assert {g[1] for g in got} == {"loose"}
    got, _ = search(spark, "server routes.rs")
    assert got[0][:2] == ("src/server/routes.rs", "strong")


def test_hidden_limit_and_overflow(spark):
    paths = [f"x/f{i:03}.rs" for i in range(70)] + ["vendor/f.rs"]
    found, _ = K.ranked(files(spark, paths), "rs", hidden=F.col("path").startswith("vendor/"))
    rows = K.first(found, 500).collect()
    assert len(rows) == 50 and {(r.total, r.overflow) for r in rows} == {(70, 20)}
    assert K.first(found).count() == 20 and K.first(found, 0).count() == 1
    assert K.first(K.ranked(files(spark, []), "rs")[0]).count() == 0


def test_frecency(spark):
    seen = spark.createDataFrame([("src/server/routes.rs", 4.0), ("src/routes/mod.rs", 8.0), ("bin/routes.rs", 99.0)], "path string, frecency double")
    got, missing = search(spark, "routes.rs", frecency=seen.where("path <> 'bin/routes.rs'"), rank_by="frecency", meta=["bin/routes.rs"])
    assert [g[0] for g in got] == ["src/server/routes.rs", "src/auth/routes.rs", "bin/routes.rs"] and missing == {}
    got, missing = search(spark, "routes.rs", frecency=seen.limit(0), rank_by="frecency")
    assert got == search(spark, "routes.rs")[0] and missing == {"frecency": "no reads are known"}


def test_registry_and_evidence(spark):
    short = K.Signal("short", 2.0, lambda c: F.when(F.length("path") < 16, 3.0))
    registry = K.Registry()
    registry.register(short)
    with pytest.raises(ValueError):
        registry.register(short)
    found, _ = K.ranked(files(spark, ROUTES), "routes", registry=registry)
    got = {r.path: (r.score, r.evidence) for r in K.first(found).collect()}
    assert got["docs/routes.md"] == (56.0, {"path_match": 50.0, "co_change": 0.0, "short": 6.0}) and got["src/auth/routes.rs"][0] == 50.0
    for bad in ({"query": " / "}, {"query": "a", "rank_by": "name"}, {"query": "a", "rank_by": "path+cochange"}):
        with pytest.raises(InvalidQuery):
            K.ranked(files(spark, ROUTES), **bad)
    assert [K.is_chore(p) for p in ("a/Cargo.lock", ".github/workflows/x.yml", ".github/workflows/x.md", "cargo.lock")] == [True, True, False, False]


def resolved(spark, hint, paths, meta=()):
    return [tuple(r) for r in K.resolve(files(spark, paths, meta), hint).orderBy("nth").collect()]


def test_resolve(spark):
    paths = ["src/a/mod.rs", "src/b/mod.rs", "lib/Main.rs", "src/main.rs/x"]
    assert resolved(spark, "./src/a/mod.rs", paths) == [("resolved", 1, "src/a/mod.rs", 0)]
    assert resolved(spark, "mod.rs", paths) == [("ambiguous", 1, "src/a/mod.rs", 0), ("ambiguous", 2, "src/b/mod.rs", 0)]
    assert resolved(spark, "b/mod.rs", paths) == [("resolved", 1, "src/b/mod.rs", 0)]
    assert resolved(spark, "main.rs", paths) == [("resolved", 1, "lib/Main.rs", 0)]
    assert resolved(spark, "MAIN", paths) == [("ambiguous", 1, "lib/Main.rs", 0), ("ambiguous", 2, "src/main.rs/x", 0)]
    assert resolved(spark, "c/mod.rs", paths) == [("not_found", None, None, 0)]
    assert resolved(spark, "logo.png", paths, ["img/logo.png"]) == [("resolved_metadata", 1, "img/logo.png", 0)]
    assert resolved(spark, "IMG/logo.png", paths, ["img/logo.png"]) == [("resolved_metadata", 1, "img/logo.png", 0)]
    assert resolved(spark, "z/mod.rs", paths, ["q/z/mod.rs"]) == [("resolved_metadata", 1, "q/z/mod.rs", 0)]
    many = resolved(spark, "f", [f"d/f{i:02}" for i in range(13)])
    assert [m[2] for m in many] == [f"d/f{i:02}" for i in range(10)] and {m[3] for m in many} == {3}
    with pytest.raises(InvalidQuery):
        K.resolve(files(spark, paths), " ./ ")

"""Bounded reach, and JSON in the JVM against the Python walk."""

import random

import pytest

from tessera.operators import extraction as E, relations as R


def plain_reach(edges, seeds, depth, most):
    hops, out, frontier = {s: 0 for s in seeds}, [], set(seeds)
    for hop in range(1, depth + 1):
        into = {}
        for u, v in set(edges):
            if v in frontier and u not in hops:
                into[u] = into.get(u, 0) + 1
        for u in sorted(into, key=lambda u: (-into[u], u)):
            hops[u] = hop
            out.append((u, hop))
        frontier = set(into)
    return sorted(out[:most]), len(out) > most


@pytest.mark.parametrize("most", [0, 1, 5, 17, 40, 10_000])
def test_bounded_reach(spark, most):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(110)] + [(100 + i, 3) for i in range(12)]
    seeds = [3, 9]
    got = R.bounded_reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "node long"), 3, most)
    want, more = plain_reach(edges, seeds, 3, most)
    assert sorted(tuple(x) for x in got.nodes.collect()) == want and got.truncated == more


def test_json_in_the_jvm(spark):
    texts = ['{"a": {"b": [1, {"c": "x"}]}, "d": null}', '{"u": "é\\"//x", "t": true, "f": 1.5, "big": 12345678901}', "[1, [2, [3]]]", '"only text"', "7", "{", "", None, '{"e": {}, "l": [], "x": 1}', str(list(range(50))), '{"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}', '{"k.l": {"": 2}}']
    files = spark.createDataFrame(list(enumerate(texts)), "path long, content string")
    got = {}
    for x in E.json_keys(files).collect():
        got.setdefault(int(x.id), []).append((x.key, x.value))
    want = {i: [(k, v.replace(": ", ":")) for k, v in E.flatten(t) if (k, v) not in (("e", "{}"), ("l", "[]"))] for i, t in enumerate(texts)}
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v}


def test_json_with_comments_and_commas(spark):
    text = '{ // first\n "a": "x // no /* comment */", /* b,\n ] */ "c": [1, 2, ], "d": "e,}", }\n// end'
    files = spark.createDataFrame([("p", text)], "path string, content string")
    assert sorted((x.key, x.value) for x in E.json_keys(files).collect()) == [("a", "x // no /* comment */"), ("c[0]", "1"), ("c[1]", "2"), ("d", "e,}")]
    plan = E.json_keys(files)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInPandas" not in plan

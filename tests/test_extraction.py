"""Extraction and views on hand-made rows."""

import pytest

from tessera.operators import extraction as E, views as V

CODE = "import os\nfrom a.b import c\n\nclass A:\n    def f(self):\n        return g(os.getcwd())\n\ndef g(x):\n    return x\n"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a.py", CODE), ("bad.py", "def ("), ("none.py", None)], "path string, content string")


def test_python(files):
    got = [(r.name, r.kind, r.depth, r.first_line, r.last_line) for r in E.python_symbols(files).orderBy("ordinal").collect()]
    assert got == [("A", "class", 0, 4, 6), ("f", "method", 1, 5, 6), ("g", "function", 0, 8, 9)]
    refs = {(r.name, r.kind, r.enclosing) for r in E.python_references(files).collect()}
    assert refs == {("os", "import", None), ("a.b.c", "import", None), ("g", "call", 1), ("getcwd", "call", 1)}
    assert {r.path: r.status for r in E.python_status(files).collect()} == {"a.py": "processed", "bad.py": "failed", "none.py": "processed"}
    assert [(r.first_line, r.code) for r in E.structural(files, "Call", "g").collect()] == [(6, "g(os.getcwd())")]
    with pytest.raises(ValueError):
        E.structural(files, "Nothing")


def test_json_keys():
    assert E.flatten('{"a": {"b": [1, {"c": "x"}]}, "d": null}') == [("a.b[0]", "1"), ("a.b[1].c", "x"), ("d", "null")]
    assert E.flatten("{") == [] and E.flatten(None) == []
    assert len(E.flatten(str(list(range(50))))) == 20


def lines(spark, text):
    return spark.createDataFrame([("p", i + 1, x) for i, x in enumerate(text.split("\n"))], "path string, line_no long, line string")


def test_dotenv_imports_signatures(spark):
    env = E.dotenv(lines(spark, "# c\nexport A='x y'\nB = 2\n\nbad"))
    assert [(r.key, r.value) for r in env.collect()] == [("A", "x y"), ("B", "2")]
    names = spark.createDataFrame([("a::{b, c}",), ("d::e",)], "name string")
    assert [r.name for r in E.expand_imports(names).collect()] == ["a::b", "a::c", "d::e"]
    found = E.signatures(lines(spark, "pub async fn run() {\n  x\nexport class Foo {"))
    assert [(r.kind, r.name) for r in found.collect()] == [("fn", "run"), ("class", "Foo")]


def test_glob():
    import re

    ok = re.compile(V.glob_regex("src/**/*.{rs,py}")).match
    assert ok("src/a/b/c.rs") and ok("src/x.py") and not ok("src/x.pyc") and not ok("a/src/x.py")
    with pytest.raises(ValueError):
        V.glob_regex("{a")

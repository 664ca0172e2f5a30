"""Structural patterns with captures, and the screening of contents."""

import pytest

from tessera.operators import secrecy as Y, structure as X


def found(pattern, content, language="rust"):
    return [(m[0], m[2], m[3]) for m in X.matches(content, X.compiled(pattern, language), language)]


def test_captures():
    assert found("let $NAME = $VALUE", "let x = 42;\nlet y = f(1, g[2]) + 3;") == [(1, "let x = 42", {"NAME": "x", "VALUE": "42"}), (2, "let y = f(1, g[2]) + 3", {"NAME": "y", "VALUE": "f(1, g[2]) + 3"})]
    assert found("struct $NAME { $$$FIELDS }", "pub struct Foo {\n  a: String,\n  b: Vec<u8>,\n}\nstruct E { }") == [(1, "struct Foo {\n  a: String,\n  b: Vec<u8>,\n}", {"NAME": "Foo", "FIELDS": "a: String,\n  b: Vec<u8>,"}), (5, "struct E { }", {"NAME": "E", "FIELDS": ""})]
    assert found("$F($A, $B)", "go(1, two(x, y))", "go") == [(1, "go(1, two(x, y))", {"F": "go", "A": "1", "B": "two(x, y)"}), (1, "two(x, y)", {"F": "two", "A": "x", "B": "y"})]
    assert found("const $NAME = $VALUE", "const x = 42;\nconst y = 'a;b'\nlet z = 1", "javascript") == [(1, "const x = 42", {"NAME": "x", "VALUE": "42"}), (2, "const y = 'a;b'", {"NAME": "y", "VALUE": "'a;b'"})]
    assert found("return $X", "def f():\n    return g(1,\n  2)\nx = 1", "python") == [(2, "return g(1,\n  2)", {"X": "g(1,\n  2)"})]


def test_repeated_holes_hold_the_same():
    assert [m[1] for m in found("$A == $A", "x == x; x == y; f(1) == f( /* c */ 1)")] == ["x == x", "f(1) == f( /* c */ 1)"]
    assert [m[1] for m in found("$_ == $_", "x == y")] == ["x == y"]
    assert found("swap($A, $B, $A)", "swap(1, 2, 1) swap(1, 2, 3)") == [(1, "swap(1, 2, 1)", {"A": "1", "B": "2"})]


def test_comments_texts_and_nothing():
    assert found("f(1)", "// f(1)\n\"f(1)\" f( /* x */ 1 )") == [(2, "f( /* x */ 1 )", {})]
    assert found("struct $N { $$$F }", "fn main() {}") == []
    assert found("f($X)", "f(") == [] and found("f($X)", "") == [] and found("f($X)", "f()") == []
    assert found("f($$$X)", "f()") == [(1, "f()", {"X": ""})]


def test_errors_are_told_apart():
    for bad in ("", "f(", "'", "$A", "$A $$$B", "/* open"):
        with pytest.raises(X.InvalidPattern):
            X.compiled(bad, "rust" if bad != "'" else "python")
    for language in ("html", "json", "klingon"):
        with pytest.raises(X.UnsupportedLanguage):
            X.compiled("f($A)", language)


def test_many_holes_end():
    assert found("f($A, $B, $C, $D)", "f(" + ", ".join(["a + b"] * 300) + ")") == []
    assert len(found("$$$A x $$$B y $$$C", "a " * 300 + ";")) == 0


def test_structural_frame(spark):
    rows = [("a.rs", "rust", "f(1); f(2);\nf(3)"), ("b.rs", "rust", "\n".join(f"f({i});" for i in range(9))), ("c.py", "python", "f(1)"), ("d.rs", "rust", None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    got = X.structural(files, "f($N)", "rust")
    assert got.count() == 12 and {r.captures["N"] for r in got.collect()} == {str(i) for i in range(9)}
    some = X.capped(got, total=4, per_file=2).collect()
    assert [(r.path, r.first_line, r.captures["N"], r.matches) for r in some] == [("a.rs", 1, "1", 12), ("a.rs", 1, "2", 12), ("b.rs", 1, "0", 12), ("b.rs", 2, "1", 12)]


# -- screening

KEY = "sk9f8a7d6s5f4g3h2j1k"
CASES = {
    "envelope": ("-----BEGIN RSA PRIVATE KEY-----", "sensitive", 1),
    "header": ("Authorization: Bearer abcdefgh12345", "sensitive", 1),
    "token": ("x ghp_" + "a" * 36, "sensitive", 1),
    "short token": ("x ghp_" + "a" * 35, "clean", 0),
    "assigned": (f"api_key = '{KEY}'\nPASSWORD: {KEY}", "sensitive", 2),
    "short": ("password = abc", "clean", 0),
    "placeholder": ("password = changeme\ntoken=<your_token_here>\nsecret: ${{ secrets.A }}\napi-key: ${A}${B}", "clean", 0),
    "placeholder with a payload": ("password = changeme + \"actualsecret\"", "sensitive", 1),
    "bracketed literal": ("password = ${A}literal${B}", "sensitive", 1),
    "list": ("token: [\"ab\", \"longenough1\"]", "sensitive", 1),
    "flow map": ("{token: \"ab\", environment: production}", "clean", 0),
    "uri": ("postgres://user:hunter22@host/db", "sensitive", 1),
    "empty": ("", "clean", 0),
    "prose": ("the key to a password is a secret", "clean", 0),
}


def test_screen(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "path string, content string")
    got = {r.path: (r.state, r.findings) for r in Y.screen(df).collect()}
    assert got == {k: v[1:] for k, v in CASES.items()}


def test_code_expressions(spark):
    rows = {"field": ("token: Arc<AtomicBool>,", 0), "call": ("let secret = load_secret(path);", 0), "literal": (f"let secret = \"{KEY}\";", 1), "payload": (f"let token = concat(prefix(), \"{KEY}\");", 1)}
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "path string, content string")
    from pyspark.sql import functions as F

    assert {r.path: r.findings for r in Y.screen(df, code=F.lit(True)).collect()} == {k: v[1] for k, v in rows.items()}
    assert {r.path: r.findings for r in Y.screen(df).collect()} == dict.fromkeys(rows, 1)


def test_what_cannot_be_read_is_withheld(spark):
    df = spark.createDataFrame([("null", None), ("bad", bytearray(b"\xff\xfe")), ("long", bytearray(b"x" * 50)), ("fine", bytearray(b"x"))], "path string, content binary")
    got = {r.path: (r.state, r.withheld) for r in Y.screen(df, limit=40).collect()}
    assert got == {"null": ("indeterminate", True), "bad": ("indeterminate", True), "long": ("indeterminate", True), "fine": ("clean", False)}

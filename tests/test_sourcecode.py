"""Source extraction against expectations written by hand, and impact on small programs."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import impact as I, sourcecode as S


def found(language, content):
    out = {"symbols": [], "references": set(), "aliases": {}, "status": None}
    rows = S.read(language, content)
    symbols = [r for r in rows if r["record"] == "symbol"]
    for r in rows:
        if r["record"] == "symbol":
            out["symbols"].append((r["kind"], r["name"], r["depth"], r["first_line"], r["last_line"]))
            assert 0 <= r["start"] <= r["stop"] <= len(content)
        elif r["record"] == "reference":
            around = None if r["enclosing"] is None else symbols[r["enclosing"]]["name"]
            out["references"].add((r["kind"], r["name"], around))
        elif r["record"] == "alias":
            out["aliases"][r["name"]] = r["target"]
        else:
            out["status"] = (r["kind"], r.get("target"), r.get("first_line"))
    return out


def test_rust():
    got = found("rust", '''use std::{collections::{HashMap as Map, HashSet}, fmt};
/* nested /* fn no() {} */ } */
const LIMIT: usize = 7;
pub struct Order<'a> { name: &'a str, part: Option<Part> }
impl<'a> fmt::Display for Order<'a> {
    fn fmt(&self, f: &mut Formatter) -> fmt::Result {
        write!(f, "{} }} // call(x)", self.name)?;
        if LIMIT > 3 { helper::<u8>(LIMIT); std::mem::swap(a, b) }
        let raw = r#"quote " and call(y) "#;
    }
}
mod inner { pub fn deep() -> Vec<Part> { vec![Part::new()] } }
trait Shape { fn area(&self) -> f64; }
''')
    assert got["symbols"] == [("constant", "LIMIT", 0, 3, 3), ("struct", "Order", 0, 4, 4), ("impl", "impl Display for Order", 0, 5, 11), ("method", "fmt", 1, 6, 10), ("module", "inner", 0, 12, 12), ("function", "deep", 1, 12, 12), ("trait", "Shape", 0, 13, 13), ("method", "area", 1, 13, 13)]
    assert got["aliases"] == {"Map": "std::collections::HashMap"} and got["status"] == ("processed", None, None)
    assert got["references"] == {("import", "std::collections::HashMap", None), ("import", "std::collections::HashSet", None), ("import", "std::fmt", None), ("type", "Option", "Order"), ("type", "Part", "Order"), ("implements", "Display", "impl Display for Order"), ("type", "Formatter", "fmt"), ("type", "Result", "fmt"), ("macro", "write", "fmt"), ("value", "LIMIT", "fmt"), ("call", "helper", "fmt"), ("call", "swap", "fmt"), ("type", "Vec", "deep"), ("type", "Part", "deep"), ("macro", "vec", "deep"), ("call", "new", "deep")}


def test_qualified_calls():
    rows = S.read("rust", "fn f() { a::b::go(1); x.run(2); Self::new() }")
    assert {(r["name"], r["qualified"]) for r in rows if r["record"] == "reference" and r["kind"] == "call"} == {("go", "a::b::go"), ("run", "x.run"), ("new", "Self::new")}


def test_python():
    got = found("python", '''import os, sys as system
from .pkg import (a as b, c)
LIMIT = 7
class Order(Base, models.Thing):
    """doc } def no(): call(x)"""
    def lines(self, n: Part) -> Other:
        x = helper(n, [1,
2])
        return os.path.join("a", LIMIT)

    async def later(self):
        # def no(): pass
        pass
def free(): return Order()
''')
    assert got["symbols"] == [("constant", "LIMIT", 0, 3, 3), ("class", "Order", 0, 4, 13), ("method", "lines", 1, 6, 9), ("method", "later", 1, 11, 13), ("function", "free", 0, 14, 14)]
    assert got["aliases"] == {"system": "sys", "b": ".pkg.a"}
    assert got["references"] == {("import", "os", None), ("import", "sys", None), ("import", ".pkg", None), ("import", ".pkg.a", None), ("import", ".pkg.c", None), ("implements", "Base", "Order"), ("implements", "Thing", "Order"), ("type", "Part", "lines"), ("type", "Other", "lines"), ("call", "helper", "lines"), ("call", "join", "lines"), ("value", "LIMIT", "lines"), ("call", "Order", "free")}


def test_typescript():
    got = found("typescript", '''import React, { useState as use, Effect } from 'react';
export const LIMIT: number = 7;
export const add = (a: number, b: number): number => a + b;
export class Order extends Base implements Shape {
  private name: string = "class No {";
  constructor(n: number) { super(n); }
  lines(n: number): Part { if (n) { return make<Part>(LIMIT); } return new Part(/a"b{/.test(n)); }
}
interface Shape { area(): number }
type Id = string | number;
''')
    assert got["symbols"] == [("constant", "LIMIT", 0, 2, 2), ("function", "add", 0, 3, 3), ("class", "Order", 0, 4, 8), ("method", "constructor", 1, 6, 6), ("method", "lines", 1, 7, 7), ("interface", "Shape", 0, 9, 9), ("method", "area", 1, 9, 9), ("type", "Id", 0, 10, 10)]
    assert {("import", "react", None), ("import", "useState", None), ("import", "Effect", None), ("implements", "Base", "Order"), ("implements", "Shape", "Order"), ("call", "make", "lines"), ("call", "Part", "lines"), ("type", "Part", "lines"), ("value", "LIMIT", "lines"), ("call", "test", "lines")} == got["references"]
    assert got["aliases"] == {"use": "useState"} and got["status"][0] == "processed"


def test_java_go_and_c():
    java = found("java", '''import java.util.List;
public class Order extends Base implements Shape, Other<Part> {
  static final int LIMIT = 7;
  public Order(int n) { super(n); }
  @Override public List<Part> lines(int n) throws IOException { return new ArrayList<>(helper(LIMIT)); }
}
enum Kind { A, B }
''')
    assert java["symbols"] == [("class", "Order", 0, 2, 6), ("constant", "LIMIT", 1, 3, 3), ("method", "Order", 1, 4, 4), ("method", "lines", 1, 5, 5), ("enum", "Kind", 0, 7, 7)]
    assert java["references"] == {("import", "java.util.List", None), ("implements", "Base", "Order"), ("implements", "Shape", "Order"), ("implements", "Other", "Order"), ("type", "Part", "Order"), ("type", "List", "Order"), ("type", "IOException", "lines"), ("call", "ArrayList", "lines"), ("call", "helper", "lines"), ("value", "LIMIT", "lines")}
    go = found("go", 'package main\nimport (\n  f "fmt"\n  "os"\n)\nconst (\n  Limit = 7\n  Other = 8\n)\ntype Order struct { name string }\ntype Shape interface {\n  Area() float64\n}\nfunc (o *Order) Line(n int) Part {\n  f.Println("}", Limit)\n  return part(n)\n}\n')
    assert go["symbols"] == [("constant", "Limit", 0, 7, 7), ("constant", "Other", 0, 8, 8), ("struct", "Order", 0, 10, 10), ("interface", "Shape", 0, 11, 13), ("method", "Area", 1, 12, 12), ("method", "Line", 0, 14, 17)]
    assert go["references"] == {("import", "fmt", None), ("import", "os", None), ("type", "Part", "Line"), ("call", "Println", "Line"), ("value", "Limit", "Line"), ("call", "part", "Line")} and go["aliases"] == {"f": "fmt"}
    c = found("c", '#include <stdio.h>\n#include "own.h"\nstruct order { int n; };\nint main(int argc, char **argv)\n{\n  printf("%d }", helper(3)); if (argc) { return 1; }\n}\n')
    assert c["symbols"] == [("struct", "order", 0, 3, 3), ("function", "main", 0, 4, 7)]
    assert c["references"] == {("import", "stdio.h", None), ("import", "own.h", None), ("call", "printf", "main"), ("call", "helper", "main")}


def test_other_languages():
    cpp = found("cpp", "namespace shop {\nclass Order : public Base {\n public:\n  int lines(int n) const { return std::max(n, helper(n)); }\n};\n}\nint shop::count(int x) { return x; }\n")
    assert [s[:3] for s in cpp["symbols"]] == [("module", "shop", 0), ("class", "Order", 1), ("method", "lines", 2), ("function", "count", 0)]
    csharp = found("csharp", "using Json = Newtonsoft.Json;\nnamespace Shop.Core {\n public class Order : Base, IShape {\n  const int LIMIT = 7;\n  public int Twice(int n) => n * LIMIT;\n }\n}\n")
    assert [s[:3] for s in csharp["symbols"]] == [("module", "Shop.Core", 0), ("class", "Order", 1), ("constant", "LIMIT", 2), ("method", "Twice", 2)]
    assert csharp["aliases"] == {"Json": "Newtonsoft.Json"} and ("value", "LIMIT", "Twice") in csharp["references"]
    ruby = found("ruby", "require 'json'\nmodule Shop\n  class Order < Base\n    def lines(n)\n      if n\n        helper(n)\n      end\n      x = 1 if n\n      [1].each do |q|\n        q.run(q)\n      end\n    end\n  end\nend\n")
    assert ruby["symbols"] == [("module", "Shop", 0, 2, 14), ("class", "Order", 1, 3, 13), ("method", "lines", 2, 4, 12)]
    assert {("implements", "Base", "Order"), ("call", "helper", "lines"), ("call", "run", "lines")} <= ruby["references"]
    kotlin = found("kotlin", "import a.b.C as D\nclass Order(val n: Int) : Base(n), Shape {\n    override fun area(): Double = helper(n)\n    fun lines(): List<Part> {\n        return make(n)\n    }\n}\n")
    assert [s[:3] for s in kotlin["symbols"] if s[0] != "variable"] == [("class", "Order", 0), ("method", "area", 1), ("method", "lines", 1)] and kotlin["aliases"] == {"D": "a.b.C"}
    php = found("php", "<?php\nnamespace App\\Models;\nuse App\\Base as B;\nclass Order extends B implements Shape {\n  const LIMIT = 7;\n  public function lines($n) { return $this->helper($n) + self::LIMIT; }\n}\n")
    assert [s[:2] for s in php["symbols"]] == [("module", "App\\Models"), ("class", "Order"), ("constant", "LIMIT"), ("method", "lines")] and php["aliases"] == {"B": "App\\Base"}


def test_html():
    got = found("html", '<!DOCTYPE html><html><head><script src="/a.js"></script><link href="b.css"></head><body><my-box #ref><a href="/x">x</a></my-box>@if (y) {<p>text<p>more} @let who = 3;</body></html>')
    assert got["symbols"] == [("other", "html", 0, 1, 1), ("other", "my-box", 2, 1, 1), ("variable", "ref", 2, 1, 1), ("module", "@if", 2, 1, 1), ("variable", "who", 4, 1, 1)]
    assert got["references"] == {("import", "/a.js", "html"), ("import", "b.css", "html"), ("value", "/x", "my-box")} and got["status"][0] == "processed"
    assert found("html", "<div><b>x</div>")["status"] == ("partial", "<b> isn't closed", 1)


@pytest.mark.parametrize("language,content,problem", [
    ("rust", "fn f() {\n  g(1);\n", ("partial", "{ isn't closed", 1)),
    ("go", "package a\nfunc f() { g(`open", ("partial", "a text isn't closed", 2)),
    ("java", "class A {\n /* open", ("partial", "{ isn't closed", 1)),
    ("typescript", "f(1))\nconst a = 'x", ("partial", ") closes nothing", 1)),
    ("python", "def f():\n  return g(1,\n", ("partial", "( isn't closed", 2)),
    ("ruby", "def f\n  g(1)\n", ("partial", "a block isn't ended", 2)),
    ("html", "<div><i>x", ("partial", "<div> isn't closed", 1)),
])
def test_files_that_break_off(language, content, problem):
    got = found(language, content)
    assert got["status"] == problem
    if language != "html":
        assert ("call", "g", "f") in got["references"] or language in ("typescript", "java", "go")


@pytest.mark.parametrize("language", sorted(S.LANGUAGES))
def test_odd_contents_never_fail(language):
    for content in ("", "\n", "{", "}", ")(", "class", "fn", "def", "import", "use a::{", "'", '"', "/*", "impl", "é" * 50, "a\0b", "#include", "from . import", "class A extends", "x = <", "func (", "const (", "enum {", "(" * 3000, "a." * 500 + "b()"):
        assert S.read(language, content)[-1]["record"] == "status"
    text = "use a::{b, c::{d as e}}; class A extends B { fn f(x: T) -> U { g!(1); h::<V>(2) } } def k(): return [1, 'x'] end import y"
    for i in range(len(text)):
        S.read(language, text[:i])
        S.read(language, text[i:])


def test_extract_and_table_function(spark):
    rows = [("a.rs", "rust", "use x as y; fn f() { g() }"), ("b.py", "python", "def h(): f("), ("c.xyz", None, "?"), ("d.go", "go", None), (None, "rust", "fn a() {}")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    facts = S.extract(files).cache()
    assert {(r.path, r.name, r.kind) for r in S.symbols(facts).collect()} == {("a.rs", "f", "function"), ("b.py", "h", "function"), (None, "a", "function")}
    assert {(r.path, r.kind, r.name, r.line) for r in S.references(facts).collect()} == {("a.rs", "import", "x", 1), ("a.rs", "call", "g", 1), ("b.py", "call", "f", 1)}
    assert {(r.path, r.status) for r in S.status(facts).collect()} == {("a.rs", "processed"), ("b.py", "partial"), ("c.xyz", "unsupported"), ("d.go", "failed"), (None, "processed")}
    assert [tuple(r) for r in S.aliases(facts).collect()] == [("a.rs", "y", "x")]
    S.register(spark)
    files.createOrReplaceTempView("own_files")
    lateral = spark.sql("SELECT path, f.record, f.name, f.kind FROM own_files, LATERAL source_facts(language, content) f")
    assert sorted(map(str, lateral.collect())) == sorted(map(str, facts.select("path", "record", "name", "kind").collect()))
    assert S.extract(files.limit(0)).count() == 0
    named = spark.createDataFrame([("a/b.RS",), ("x.tsx",), ("Makefile",), ("q.htm",)], "p string")
    assert [r[0] for r in named.select(S.language_of(F.col("p"))).collect()] == ["rust", "typescript", None, "html"]


# -- impact

MAIN = "mod a;\nfn main() {\n    a::call_a();\n}\n"
CORE = "pub fn core() -> u32 {\n    0\n}\n"


def files(spark, told):
    return spark.createDataFrame([(p, "rust", c) for p, c in told.items()], "path string, language string, content string")


def test_impact_of_a_changed_body(spark):
    old = {"src/main.rs": MAIN, "src/core.rs": CORE, "src/a.rs": "pub fn call_a() -> u32 {\n    core()\n}\n"}
    new = old | {"src/a.rs": "// moved\n\npub fn call_a() -> u32 {\n    core() + 1\n}\n", "src/core.rs": "// only moved\n" + CORE}
    got = I.impact(files(spark, old), files(spark, new), I.options(["main"]))
    assert {tuple(r) for r in got.files.collect()} == {("src/a.rs", "modified"), ("src/core.rs", "modified")}
    assert [tuple(r) for r in got.symbols.collect()] == [("src/a.rs", "call_a", "function", "changed", 1, 3)]
    assert [tuple(r) for r in got.blast.collect()] == [("src/main.rs::main", 1, "critical")]
    counts = {r["list"]: (r.total, r.returned, r.truncated) for r in got.counts().collect()}
    assert counts == {"changed_files": (2, 2, False), "changed_symbols": (1, 1, False), "blast_radius": (1, 1, False), "risk:critical": (1, None, False), "risk:high": (0, None, False), "risk:medium": (0, None, False), "risk:low": (0, None, False)}


def test_hops_and_scopes(spark):
    old = {"core.rs": CORE, "a.rs": "fn a() { core() }", "b.rs": "fn b() { a() }", "c.rs": "fn c() { b() }", "d.rs": "fn d() { c() }\nfn d2() { a() }"}
    new = old | {"core.rs": CORE.replace("0", "1"), "new.rs": "fn fresh() { d() }"}
    blast = lambda **asked: {tuple(r) for r in I.impact(files(spark, old), files(spark, new), I.options(["main"], **asked), untracked=spark.createDataFrame([("new.rs",)], "path string")).blast.collect()}
    assert blast() == {("a.rs::a", 1, "high"), ("b.rs::b", 2, "medium"), ("d.rs::d2", 2, "medium")}
    assert blast(depth=9) == {("a.rs::a", 1, "high"), ("b.rs::b", 2, "medium"), ("d.rs::d2", 2, "medium"), ("c.rs::c", 3, "low"), ("d.rs::d", 4, "low")}
    assert blast(scope="files", depth=4) == {("a.rs", 1, "high"), ("b.rs", 2, "medium"), ("c.rs", 3, "low"), ("d.rs", 2, "medium")}
    assert blast(depth=0) == set()
    with_new = I.impact(files(spark, old), files(spark, new), I.options(["main"]))
    assert {r.path for r in with_new.symbols.collect()} == {"core.rs", "new.rs"}
    left_out = I.impact(files(spark, old), files(spark, new), I.options(["main"], include_untracked=False), untracked=spark.createDataFrame([("new.rs",)], "path string"))
    assert {r.path for r in left_out.symbols.collect()} == {"core.rs"}


def test_lists_are_capped_and_counts_are_not(spark):
    pads = lambda by: "".join(f"pub fn pad_{i}() -> u32 {{\n    {i + by}\n}}\n" for i in range(210))
    callers = "".join(f"pub fn caller_{i}() -> u32 {{\n    core()\n}}\n" for i in range(210))
    old = {"changed.rs": CORE + pads(0), "callers.rs": callers}
    got = I.impact(files(spark, old), files(spark, old | {"changed.rs": CORE.replace("0", "1") + pads(1)}), I.options(["main"]))
    counts = {r["list"]: (r.total, r.returned, r.truncated) for r in got.counts().collect()}
    assert counts["changed_files"] == (1, 1, False) and counts["changed_symbols"] == (211, 200, True) and counts["blast_radius"] == (210, 200, True) and counts["risk:high"][0] == 210
    assert got.shown_symbols().count() == got.shown_blast().count() == 200 and got.shown_files().count() == 1


def test_names_that_a_file_has_more_than_once(spark):
    one = lambda *bodies: "".join(f"impl T{i} {{\n  fn go() {{ {b} }}\n}}\n" for i, b in enumerate(bodies))
    s = lambda text: S.symbols(S.extract(files(spark, {"x.rs": text}))).where("name = 'go'")
    got = {(r.change, r.old_line, r.new_line) for r in I.changed_symbols(s(one("1", "2", "3")), s(one("1", "9", "3", "4"))).collect()}
    assert got == {("changed", 5, 5), ("added", None, 11)}
    assert I.changed_symbols(s(one("1", "2")), s("\n\n" + one("1", "2"))).count() == 0


def test_equal_texts_match_before_near_lines(spark):
    one = lambda *bodies: "".join(f"impl T{i} {{\n  fn go() {{ {b} }}\n}}\n" for i, b in enumerate(bodies))
    s = lambda text: S.symbols(S.extract(files(spark, {"x.rs": text}))).where("name = 'go'")
    changed = lambda old, new: {(r.change, r.old_line, r.new_line) for r in I.changed_symbols(s(old), s(new)).collect()}
    assert changed(one("1", "2"), one("9", "1", "2")) == {("added", None, 2)}
    assert changed(one("9", "1", "2"), one("1", "2")) == {("removed", 2, None)}
    assert changed(one("1", "2", "3"), one("3", "1", "8")) == {("changed", 5, 8)}
    # of equal texts the nearest match, and one to one
    assert changed(one("1", "1", "2"), one("4", "1", "2")) == {("changed", 2, 2)}
    assert changed(one("1", "1", "1"), one("1")) == {("removed", 5, None), ("removed", 8, None)}
    # two on one line
    assert changed("impl A { fn go() { 1 } }  impl B { fn go() { 2 } }", "impl A { fn go() { 1 } }  impl B { fn go() { 3 } }") == {("changed", 1, 1)}


def test_moved_texts_in_the_counts_and_the_report(spark):
    old = {"x.rs": "impl A { fn go() { 1 } }\nimpl B { fn go() { 2 } }\n", "y.rs": "fn main() { 5 }\n"}
    new = old | {"x.rs": "impl N { fn up() { go() } }\nimpl A { fn go() { 1 } }\nimpl B { fn go() { 2 } }\nimpl C { fn go() { 3 } }\n"}
    got = I.impact(files(spark, old), files(spark, new), I.options(["main"]))
    assert {r["list"]: r.total for r in got.counts().collect()}["changed_symbols"] == 4  # N, up, C and C's go
    assert {(r.name, r.change, r.old_line, r.new_line) for r in got.symbols.where("name = 'go'").collect()} == {("go", "added", None, 4)}


def test_options():
    assert I.options(["origin/main", "main"]) == I.Options("origin/main", notes=("compared with origin/main, not with the local main",))
    assert I.options(["main"]) == I.Options("main", 2, "symbols", True, ())
    assert I.options(["main", "v1"], since="v1", base_branch="main").base == "v1"
    assert I.options(["main"], base_branch="main", depth=5).notes == ()
    deep = I.options(["main"], depth=9)
    assert deep.depth == 5 and deep.notes == ("depth 9 is more than 5; 5 is used",)
    for bad in ({"since": "gone"}, {"scope": "lines"}, {"depth": -1}):
        with pytest.raises(ValueError):
            I.options(["main"], **bad)
    with pytest.raises(ValueError, match="invalid ref"):
        I.options([])

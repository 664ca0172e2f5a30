"""All sections about symbols of a small program."""

import pytest

from tessera.operators import sourcecode as S, symbolviews as W

PROGRAM = {
    "src/shape.rs": "pub trait Shape { fn area(&self) -> f64; }\npub struct Disc { r: f64 }\nimpl Shape for Disc {\n  fn area(&self) -> f64 { pi(self.r) }\n}\nfn pi(r: f64) -> f64 { square(r) * 3.14 }\nfn square(r: f64) -> f64 { r * r }\n",
    "src/main.rs": "use crate::shape::Disc;\nfn main() { let d: Disc = make(); square(2.0); square(3.0); }\nfn make() -> Disc { todo!() }\n",
    "src/other.py": "import shape\ndef square(x):\n    return x\n",
}


@pytest.fixture(scope="module")
def program(spark):
    files = spark.createDataFrame([(p, "rust" if p.endswith("rs") else "python", c) for p, c in PROGRAM.items()], "path string, language string, content string")
    return files, S.extract(files).cache()


def ask(spark, *rows):
    return spark.createDataFrame([(f"q{i}", *r) for i, r in enumerate(rows)], "request string, path string, name string, kind string, line int")


def test_selected(spark, program):
    asked = ask(spark, ("src/shape.rs", "pi", None, None), ("src/shape.rs", "area", None, None), ("src/shape.rs", "area", None, 4), ("src/shape.rs", "Disc", "struct", None), ("src/shape.rs", "gone", None, None), ("src/none.rs", "pi", None, None), ("src/shape.rs", "pi", "struct", None))
    got = {r.request: (r.state, r.lines) for r in W.selected(asked, program[1]).collect()}
    assert got == {"q0": ("found", None), "q1": ("ambiguous", [1, 4]), "q2": ("found", None), "q3": ("found", None), "q4": ("symbol_not_found", None), "q5": ("file_not_found", None), "q6": ("symbol_not_found", None)}


def test_sections(spark, program):
    files, facts = program
    history = spark.createDataFrame([("src/shape.rs", 7, "2024-05-01")], "path string, commits long, last_ts string")
    asked = ask(spark, ("src/shape.rs", "square", None, None), ("src/shape.rs", "Disc", "struct", None), ("src/shape.rs", "Shape", None, None))
    every = W.entries(asked, facts, files, history=history)
    got = {}
    for r in W.shown(every).orderBy("request", "section", "nth").collect():
        got.setdefault((r.request, r.section), []).append((r.name, r.path.split("/")[-1], r.line, r.detail))
    assert got["q0", "body"] == [("square", "shape.rs", 7, "fn square(r: f64) -> f64 { r * r }")]
    assert got["q0", "callers"] == [("square", "main.rs", 2, "in function main"), ("square", "main.rs", 2, "in function main"), ("square", "shape.rs", 6, "in function pi")]
    assert ("q0", "callees") not in got
    assert got["q0", "siblings"] == [("Shape", "shape.rs", 1, None), ("Disc", "shape.rs", 2, None), ("impl Shape for Disc", "shape.rs", 3, None), ("pi", "shape.rs", 6, None)]
    assert got["q0", "dependents"] == [("crate::shape::Disc", "main.rs", 1, None), ("shape", "other.py", 1, None)]
    assert got["q0", "activity"] == [("square", "shape.rs", None, "7 commits, last 2024-05-01")]
    assert got["q1", "usages"] == [("Disc", "main.rs", 2, "in function main"), ("Disc", "main.rs", 3, "in function make")]
    assert got["q1", "implementations"] == [("Shape", "shape.rs", 3, None)]
    assert got["q2", "implementations"] == [("Disc", "shape.rs", 3, None)] == got["q2", "suggestions"]
    totals = {(r.request, r.section): (r.total, r.names, r.overflow) for r in W.totals(every, cap=2).collect()}
    assert totals["q0", "callers"] == (3, 1, 1) and totals["q1", "usages"] == (2, 1, 0)


def test_chosen_sections(spark, program):
    files, facts = program
    asked = ask(spark, ("src/shape.rs", "pi", None, None))
    assert {r.section for r in W.entries(asked, facts, files, sections=["callees"]).collect()} == {"callees"}
    assert W.entries(asked, facts, files, sections=["activity"]).count() == 0
    assert W.entries(asked.limit(0), facts, files).count() == 0
    with pytest.raises(ValueError):
        W.entries(asked, facts, files, sections=["body", "all"])

"""Files of one shape are read once, and their records are those of a plain reading."""

import random

import pyarrow as pa

from tessera.operators import sourcecode as S
from tessera.operators.sourceshapes import Shapes

_PIECES = {
    "python": ["def f@(x@):\n", "    return g@(a@) + 12\n", "class A@(B@, c@.D@):\n", "LIMIT_@ = 7\n", "    x = LIMIT_@\n", "import a@.b@ as c@\n", "from . import d@\n", "if x@: \n", "# no @\n", 't = "a@ \\n"\n', "    def m@(self) -> T@:\n        pass\n", "x@ = 1; async def h@(): pass\n", "k = 'a@'\n", "1e@ @.5 %s @% é@\n", "(\n", ")"],
    "rust": ["use crate::a@::{b@ as c@, d@};\n", "fn f@(x: &T@) -> U@ { g@::h@(x@) }\n", "impl Stock@ for Order@ {\n", "const L@: u32 = 7;\n", "}\n", "check@!(\"}@\", L@);\n", "struct S@ { a: u8 }\n", "// @ }\n", "let c = '5'; let d = 'x';\n", "r#\"a@\"#;\n", "'a@: loop {\n"],
    "typescript": ["import { A@, b@ as c@ } from 'st@re@';\n", "export function f@(n: number): T@ {\n", "  return g@(n) + h@.k@(@);\n", "}\n", "class C@ extends D@ implements E@ { m@(): P@ { return q@(`}@`); } }\n", "const K@ = (a) => b@(a);\n", "let L@: number = 7;\n", "x = /a@[/]/g;\n", "// @\n", "/* @\n*/"],
    "java": ["import a@.b@;\n", "class C@ extends D@ {\n", "  static final int L@ = 7;\n", "  Part m@(int a@) { return p@('}', L@, '\\u00@'); }\n", "}\n", "new X@();\n"],
    "go": ["package m@\n", "import (\n  f@ \"a/b@\"\n)\n", "func (o *O@) l@() P@ { return p@(\"}\", L@) }\n", "const L@ = 7\n", "type T@ struct { c int }\n", "func f@(n int) int {\n\treturn g@(n)\n}\n", "var (\n a@ = 1\n b@ = c@()\n)\n"],
    "ruby": ["def f@(a)\n  g@(a)\nend\n", "class A@ < B@\nend\n", "L@ = 5\n", "require 'a@'\n", "x if y@\n"],
    "cpp": ["#include <a@.h>\n", "namespace n@::m@ {\n", "int f@(T@ a) { return g@(a); }\n", "}\n", "class A@ : public B@ {};\n"],
    "php": ["use A@\\B@ as C@;\n", "function f@($a@) { return g@($a@); }\n", "class D@ extends E@ {}\n"],
}


def _files(rng, n):
    """Files in groups of a shape, and some that only seem to be of one."""
    for _ in range(n):
        language = rng.choice([*_PIECES])
        pieces = [rng.choice(_PIECES[language]) for _ in range(rng.randrange(1, 9))]
        marks = "".join(pieces).count("@")
        turns = [rng.randrange(max(marks, 1)) for _ in range(marks)]
        for _ in range(4):
            numbers = [str(rng.choice([rng.randrange(10), rng.randrange(10**7), f"00{rng.randrange(99)}"])) for _ in range(marks + 1)]
            parts = "".join(pieces).split("@")
            yield language, parts[0] + "".join(numbers[t] + p for t, p in zip(turns, parts[1:], strict=True))


def test_shapes_have_the_records_of_a_plain_reading():
    names = S._FIELDS
    shapes = Shapes(S.read, S.LANGUAGES, S.RECORDS, names)
    filled = 0
    for language, content in _files(random.Random(3), 600):
        before = len(shapes.held)
        got = [[*c] for c in shapes.columns(language, content)]
        assert got == [[r.get(n) for r in S.read(language, content)] for n in names], (language, content)
        filled += len(shapes.held) > before
    assert filled == len(shapes.held) and sum(t is not None for t in shapes.held.values()) > 300


def test_columns_before_blocks_and_lengths_of_characters_count():
    """Digits that move a block's column or end a character in quotes aren't left out."""
    for language, text in (("python", "if a@: def f():\n        g()\n       \n      h()\n"), ("rust", "let a = '@'; f@(1);\n"), ("java", "class A { int f() { return g('@', b); } }\n")):
        shapes = Shapes(S.read, S.LANGUAGES, S.RECORDS, S._FIELDS)
        for number in ("1", "2", "33333", "4", "77777777"):
            content = text.replace("@", number)
            assert [[*c] for c in shapes.columns(language, content)] == [[r.get(n) for r in S.read(language, content)] for n in S._FIELDS]


def test_a_shape_is_read_once():
    read = []
    shapes = Shapes(lambda *a: read.append(a[1]) or S.read(*a), S.LANGUAGES, ("symbol", "reference"), ["name", "kind", "digest", "start", "stop", "around"])
    for k in range(200):
        content = f"def order_{k}(n):\n    return part_{k * k + 1000}(n) + part_{k + 2000}(n)\n"
        name, _, digest, start, stop, around = shapes.columns("python", content)
        assert (*name,) == (f"order_{k}", f"part_{k * k + 1000}", f"part_{k + 2000}") and content[start[0] : stop[0]] == content[:-1] and around[1] == f"order_{k}"
    assert len(read) == 3


def test_numbers_equal_by_chance_make_no_other_shape():
    """Only runs in names of constants, variables, imports and aliases, and in words like them, are compared."""
    read = []
    shapes = Shapes(lambda *a: read.append(a[1]) or S.read(*a), S.LANGUAGES, S.RECORDS, S._FIELDS)
    rng = random.Random(1)
    for k in range(300):
        n = [rng.randrange(1, 8) for _ in range(8)]
        content = f"import a.supplier_{k + 90} as first\nLIMIT_{k} = 7\nclass Order_{k}:\n" + "".join(f"    def line_{i}(self):\n        return part_{j}(LIMIT_{k}, {i})\n" for i, j in zip(n[:4], n[4:], strict=True))
        assert [[*c] for c in shapes.columns("python", content)] == [[r.get(x) for r in S.read("python", content)] for x in S._FIELDS]
    assert len(read) <= 5


def test_numbers_of_names_that_are_compared():
    """A constant that a later word equals or not, an import that is renamed or only named again."""
    shapes = Shapes(S.read, S.LANGUAGES, S.RECORDS, S._FIELDS)
    for a, b in [(1, 2), (3, 4), (5, 5), (6, 6), (7, 8), (9, 9)] * 2:
        for language, content in (("python", f"L_{a} = 7\ndef f(n):\n    return g(L_{b})\n"), ("python", f"import a{a} as a{b}\nimport c{a} as d{a}\n"), ("rust", f"use x::{{m as a{a}, n as a{b}}};\nconst T{a}: u32 = 1;\nfn f() -> T{b} {{ g() }}\n"), ("go", f'import (\n  a{a} "a{b}"\n)\n')):
            assert [[*c] for c in shapes.columns(language, content)] == [[r.get(x) for r in S.read(language, content)] for x in S._FIELDS], content


def test_shapes_that_dont_come_again_are_bounded(monkeypatch):
    import tessera.operators.sourceshapes as H

    monkeypatch.setattr(H, "SEEN", 10)
    monkeypatch.setattr(H, "HELD", 5)
    shapes = Shapes(S.read, S.LANGUAGES, S.RECORDS, S._FIELDS)
    for k in range(100):
        for _ in range(2):
            shapes.columns("python", "x" * (k + 1) + " = 1\n")
    assert len(shapes.seen) <= 10 and len(shapes.held) <= 5


def test_long_files_and_other_languages_are_read_as_they_are():
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b", "c", "d"], "language": ["python", None, "html", "python"], "content": ["f(1)\n" * 5000, "x", "<a href='b'>c</a>", None]})
    got = pa.Table.from_batches(S._batches(iter([batch]), S.RECORDS)).to_pylist()
    want = [{"path": p, **{n: r.get(n) for n in S._FIELDS}} for p, lang, c in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in S.read(lang, c)]
    assert got == want

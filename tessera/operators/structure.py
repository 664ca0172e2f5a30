"""Search for code of a shape: patterns with named holes, over tokens and matching brackets.

A pattern is code of the language with holes: ``$NAME`` stands for one piece of an
expression (no comma or semicolon outside brackets), ``$$$NAME`` for any number of
them, also none. A name that occurs twice must hold the same tokens both times.
White space and comments don't matter. A hole takes as little as lets the rest
match, the last one all that is left of its statement. Each place is tried once.

A pattern that isn't code, and a language without a lexer, are different errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators.search import InvalidQuery
from tessera.operators.sourcecode import LANGUAGES, Source

#: Matches shown in all and of one file.
TOTAL, PER_FILE = 50, 5
#: Steps a place may take before it counts as no match.
STEPS = 20_000
_HOLE = re.compile(r"(\$\$\$|\$)([A-Z_][A-Z0-9_]*)")


class InvalidPattern(InvalidQuery):
    """The pattern is no code with holes."""


class UnsupportedLanguage(InvalidQuery):
    """No lexer knows the language."""


@cache
def compiled(pattern: str, language: str) -> tuple[tuple[str, str], ...]:
    """The pattern's tokens: (``is``, text), (``one``, name) or (``many``, name)."""
    if language not in LANGUAGES:
        raise UnsupportedLanguage(f"{language} has no structural search")
    marked = _HOLE.sub(lambda m: f" hole_{'many' if len(m[1]) > 1 else 'one'}_{m[2]} ", pattern)
    source = Source(language, marked)
    if source.problem or not source.tokens:
        raise InvalidPattern(f"invalid pattern: {source.problem[1] if source.problem else 'it is empty'}")
    out = []
    for t in source.tokens:
        hole = re.fullmatch(r"hole_(one|many)_(\w+)", t.text)
        out.append((hole[1], hole[2]) if hole else ("is", t.text))
    if all(kind != "is" for kind, _ in out):
        raise InvalidPattern("invalid pattern: it has nothing but holes")
    return tuple(out)


class _Match:
    def __init__(self, s: Source, pattern: tuple[tuple[str, str], ...]) -> None:
        self.s, self.pattern = s, pattern
        self.by_line = s.rules.lines or s.language in ("python", "ruby")

    def text(self, a: int, b: int) -> tuple[str, ...]:
        return tuple(t.text for t in self.s.tokens[a:b])

    def ends(self, i: int, many: bool, last: bool) -> list[int]:
        """Where a hole that begins at ``i`` may end, the best first."""
        s, out, j = self.s, [i] if many else [], i
        while j < s.size:
            t = s.text(j)
            if t in (")", "]", "}") or (not many and t in (",", ";")) or (many and last and t == ";"):
                break
            if last and self.by_line and j > i and s.tokens[j].line > s.tokens[j - 1].line:
                break
            j = s.beyond(j)
            out.append(min(j, s.size))
        return out[::-1] if last else out

    def at(self, i: int) -> tuple[int, dict[str, tuple[int, int]]] | None:
        """The end of a match at token ``i`` and what its holes hold."""
        todo = [(0, i, {})]
        for _ in range(STEPS):
            if not todo:
                return None
            p, j, held = todo.pop()
            if p == len(self.pattern):
                return j, held
            kind, value = self.pattern[p]
            if kind == "is":
                if self.s.text(j) == value:
                    todo.append((p + 1, j + 1, held))
                continue
            for end in reversed(self.ends(j, kind == "many", p + 1 == len(self.pattern))):
                if value == "_" or value not in held:
                    todo.append((p + 1, end, held if value == "_" else held | {value: (j, end)}))
                elif self.text(*held[value]) == self.text(j, end):
                    todo.append((p + 1, end, held))
        return None


def matches(content: str, pattern: tuple[tuple[str, str], ...], language: str) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(first line, last line, code, text of each hole)."""
    s = Source(language, content)
    m = _Match(s, pattern)
    for i in range(s.size):
        if pattern[0][0] == "is" and s.text(i) != pattern[0][1]:
            continue
        if pattern[0][0] != "is" and s.text(i) in (")", "]", "}", ",", ";"):
            continue
        found = m.at(i)
        if found and found[0] > i:
            end, held = found
            last = s.tokens[end - 1]
            code = lambda a, b: content[s.tokens[a].start : s.tokens[b - 1].stop] if b > a else ""
            yield s.tokens[i].line, last.line + last.text.count("\n"), code(i, end), {n: code(a, b) for n, (a, b) in held.items()}


def structural(files: DataFrame, pattern: str, language: str) -> DataFrame:
    """(path, first_line, last_line, code, captures) of files (path, language, content) of a language."""
    shape = compiled(pattern, language)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *m) for p, c in zip(f.path, f.content, strict=True) for m in matches(c, shape, language)]
            yield pd.DataFrame(rows, columns=["path", "first_line", "last_line", "code", "captures"])

    own = files.where((F.col("language") == language) & F.col("content").isNotNull())
    return own.select("path", "content").mapInPandas(run, "path string, first_line int, last_line int, code string, captures map<string,string>")


def capped(found: DataFrame, *, total: int = TOTAL, per_file: int = PER_FILE) -> DataFrame:
    """The first matches by path and line, some of each file, with the number of all: (path, first_line, code, captures, matches)."""
    order = ["first_line", "last_line", "code"]
    nth = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    every = found.agg(F.count("*").alias("matches"))  # one row
    return found.withColumn("_n", nth).where(F.col("_n") <= per_file).orderBy("path", *order).limit(total).crossJoin(F.broadcast(every)).select("path", "first_line", "code", "captures", "matches")

"""Symbols, references, aliases and a status from source files of many languages.

A tolerant lexer (one pattern a language) turns a file into words, numbers, texts
and marks; comments go. Brackets are matched once, so nesting is known at each
token, also in files that break off: an open bracket or text makes the file
``partial``, and what was read up to there stands. Definitions are read from
keywords, or, where a language has none, from a name, brackets and a body;
Python's blocks come from indentation, Ruby's from ``end``, HTML from the standard
library's parser.

:func:`extract` parses each file once and emits rows of all records, tagged by
``record``:

* ``symbol``: ordinal, name, kind, depth, first_line, last_line, start, stop (in
  code points), enclosing (the ordinal around it; around and around_kind: its name and kind),
  digest (of its text).
* ``reference``: name, kind (call, import, type, macro, implements, value),
  first_line, enclosing, around, around_kind, qualified (the whole path), target
  (who implements).
* ``alias``: name, target (the original).
* ``status``: kind ``processed``, ``partial``, ``failed`` or ``unsupported``, name
  (the language), target (what is wrong), first_line (where).

A null content has failed. Names in comments and texts are never references.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from hashlib import sha256
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from tessera.operators.sourceshapes import Shapes

FACTS = "record string, ordinal int, name string, kind string, depth int, first_line int, last_line int, start int, stop int, enclosing int, qualified string, target string, digest string, around string, around_kind string"
_FIELDS = [f.split()[0] for f in FACTS.split(", ")]
#: Rows that a task holds before it passes them on.
STRETCH = 4096
#: Bytes of a batch whose texts are taken all at once.
SHORT = 4 << 20

# How languages write comments, texts, definitions and imports.
_SLASHES, _HASH = r"//[^\n]*", r"#[^\n]*"
_DOUBLE, _SINGLE, _BACKTICK = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"
_CHARACTER = r"'(?:\\(?:x[0-9a-fA-F]+|u\{?[0-9a-fA-F]+\}?|.)|[^'\\\n])'"
_TRIPLE = r'"""(?:\\.|[^\\])*?"""'
_RAW_HASH = r'b?r(?P<hashes>#*)".*?"(?P=hashes)'
_PATTERN_TEXT = r"(?<=[(,=:\[!&|?{};])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"


@dataclass(frozen=True)
class Language:
    """``definitions``: kind by keyword. ``bare``: functions without a keyword, in a ``class`` or ``anywhere``. ``heritage``: words or marks before what a class extends."""

    definitions: dict[str, str]
    text: str
    comment: str = _SLASHES
    block: bool = True
    nested: bool = False
    bare: str = ""
    heritage: tuple[str, ...] = ()
    variables: dict[str, str] = field(default_factory=dict)
    types: bool = True
    lines: bool = False  # a line's end may end a statement


_CLASSES = {"class": "class", "interface": "interface", "enum": "enum"}
LANGUAGES: dict[str, Language] = {
    "rust": Language({"fn": "function", "struct": "struct", "enum": "enum", "union": "struct", "trait": "trait", "mod": "module", "type": "type", "impl": "impl", "macro_rules": "macro"}, rf'{_RAW_HASH}|b?"(?:\\.|[^"\\])*"|{_CHARACTER}', nested=True, variables={"const": "constant", "static": "constant"}),
    "go": Language({"func": "function", "type": "type"}, rf"{_DOUBLE}|{_BACKTICK}|{_CHARACTER}", variables={"const": "constant", "var": "variable"}, lines=True),
    "java": Language({**_CLASSES, "record": "class"}, rf"{_TRIPLE}|{_DOUBLE}|{_CHARACTER}", bare="class", heritage=("extends", "implements"), variables={"final": "constant"}),
    "javascript": Language({"class": "class", "function": "function"}, rf"{_PATTERN_TEXT}|{_DOUBLE}|{_SINGLE}|{_BACKTICK}", bare="class", heritage=("extends",), variables={"const": "constant", "let": "variable", "var": "variable"}, types=False, lines=True),
    "typescript": Language({**_CLASSES, "function": "function", "namespace": "module", "type": "type"}, rf"{_PATTERN_TEXT}|{_DOUBLE}|{_SINGLE}|{_BACKTICK}", bare="class", heritage=("extends", "implements"), variables={"const": "constant", "let": "variable", "var": "variable"}, lines=True),
    "c": Language({"struct": "struct", "enum": "enum", "union": "struct"}, rf"{_DOUBLE}|{_CHARACTER}", bare="anywhere"),
    "cpp": Language({"class": "class", "struct": "struct", "enum": "enum", "union": "struct", "namespace": "module"}, rf"{_DOUBLE}|{_CHARACTER}", bare="anywhere", heritage=(":",)),
    "csharp": Language({**_CLASSES, "struct": "struct", "record": "class", "namespace": "module"}, rf'@"(?:""|[^"])*"|{_TRIPLE}|{_DOUBLE}|{_CHARACTER}', bare="class", heritage=(":",), variables={"const": "constant"}),
    "kotlin": Language({**_CLASSES, "object": "class", "fun": "function", "typealias": "type"}, rf"{_TRIPLE}|{_DOUBLE}|{_CHARACTER}", nested=True, heritage=(":",), variables={"val": "variable", "var": "variable"}, lines=True),
    "swift": Language({"class": "class", "struct": "struct", "enum": "enum", "protocol": "interface", "extension": "impl", "func": "function", "typealias": "type"}, rf"{_TRIPLE}|{_DOUBLE}", nested=True, heritage=(":",), variables={"let": "variable", "var": "variable"}, lines=True),
    "php": Language({**_CLASSES, "trait": "trait", "function": "function", "namespace": "module"}, rf"{_DOUBLE}|{_SINGLE}", comment=rf"{_SLASHES}|#(?!\[)[^\n]*", heritage=("extends", "implements"), variables={"const": "constant"}),
    "dart": Language({**_CLASSES, "mixin": "class", "extension": "impl"}, rf"{_TRIPLE}|{_DOUBLE}|{_SINGLE}", nested=True, bare="anywhere", heritage=("extends", "implements", "with")),
    "python": Language({"def": "function", "class": "class"}, rf"(?:[rbuRBUfF]{{0,2}})(?:{_TRIPLE}|'''(?:\\.|[^\\])*?'''|{_DOUBLE}|{_SINGLE})", comment=_HASH, block=False),
    "ruby": Language({"def": "function", "class": "class", "module": "module"}, rf"{_DOUBLE}|{_SINGLE}", comment=_HASH, block=False),
}
#: Words that stand before a bracket and call nothing, in all languages and in each.
_CONTROL = frozenset("if for while return else do case in".split())
CONTROL: dict[str, frozenset[str]] = {
    name: _CONTROL | frozenset(words.split())
    for name, words in {
        "rust": "match loop let mut ref move as fn where unsafe async await dyn impl pub crate self super",
        "go": "switch select defer go func range var const type chan map",
        "java": "switch catch try throw new synchronized super this assert instanceof",
        "javascript": "switch catch try throw new typeof await yield of delete void super this function instanceof",
        "typescript": "switch catch try throw new typeof await yield of delete void super this function instanceof keyof readonly",
        "c": "switch sizeof",
        "cpp": "switch sizeof catch try throw new delete this decltype alignof noexcept",
        "csharp": "switch catch try throw new using lock foreach fixed typeof nameof base this await when is as",
        "kotlin": "when catch try throw super this is as fun constructor",
        "swift": "switch guard catch try throw self super is as func",
        "php": "switch catch try throw new elseif foreach isset unset print match function fn list",
        "dart": "switch catch try throw new super this await assert is as",
        "python": "not and or is lambda elif with except raise del assert yield await from import class def",
        "ruby": "unless until then begin yield super self not and or when elsif rescue ensure end do",
    }.items()
}
#: What an import begins with.
_IMPORTS = {"rust": ("use",), "go": ("import",), "java": ("import",), "kotlin": ("import",), "swift": ("import",), "dart": ("import", "export"), "javascript": ("import", "require"), "typescript": ("import", "require"), "csharp": ("using",), "cpp": ("using", "#"), "c": ("#",), "php": ("use",), "ruby": ("require", "require_relative")}
_LIKE_CLASSES = {"class", "struct", "interface", "trait", "impl", "enum", "module"}
_BEFORE_NAMES = {".", "::", "->", "?.", "\\"}
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int
    line: int


_WORD, _NUMBER, _MARK = r"[^\W\d][\w$]*", r"\d(?:\w|\.\d)*", r"::|->|=>|\?\.|==|!=|<=|>=|&&|\|\||\S"
#: What comments and texts of all languages begin with or hold, and the tokens of a file without them.
_BEGINS, _PLAIN = re.compile("[\"'`#/]"), re.compile(f"{_WORD}|{_NUMBER}|{_MARK}")


class _Kinds(dict):
    """The kind of a token outside texts, by its first character."""

    def __missing__(self, c: str) -> str:
        self[c] = kind = "word" if re.match(_WORD, c) else "number" if re.match(_NUMBER, c) else "mark"
        return kind


_KINDS = _Kinds()


@cache
def _pattern(name: str) -> re.Pattern:
    lang = LANGUAGES[name]
    block = [r"(?P<block>/\*)"] if lang.block else []
    parts = [rf"(?P<comment>{lang.comment})", *block, rf"(?P<text>{lang.text})", r"(?P<label>'\w+)" if name == "rust" else r"(?P<open>\"\"\"|'''|[\"'`])", rf"(?P<word>{_WORD})", rf"(?P<number>{_NUMBER})", rf"(?P<mark>{_MARK})"]
    if name == "rust":
        parts.insert(4, r"(?P<open>\")")
    return re.compile("|".join(parts), re.DOTALL)


class Source:
    """A file's tokens, their matching brackets, and what was wrong first.

    Tokens lie in columns (``kinds``, ``texts``, ``starts``, ``lines``); ``tokens`` has them as objects.
    """

    def __init__(self, language: str, content: str) -> None:
        self.language, self.rules, self.content = language, LANGUAGES[language], content
        self.problem: tuple[int, str] | None = None
        if _BEGINS.search(content):
            found = self._lex()
            self.kinds, self.texts, self.starts, self.lines = zip(*found, strict=True) if found else ((), (), (), ())
        else:
            self._plain()
        self.size = len(self.texts)
        self.words = [k == "word" for k in self.kinds]
        self._match()

    @cached_property
    def tokens(self) -> list[Token]:
        return [Token(k, t, s, s + len(t), n) for k, t, s, n in zip(self.kinds, self.texts, self.starts, self.lines, strict=True)]

    def stop(self, i: int) -> int:
        return self.starts[i] + len(self.texts[i])

    def _plain(self) -> None:
        """The same tokens as ``_lex`` finds, of a file that can't hold comments or texts."""
        content = self.content
        self.texts, self.starts, self.lines = _PLAIN.findall(content), [], []
        at, line, newline = 0, 1, content.find("\n")
        for text in self.texts:
            at = content.index(text, at)
            self.starts.append(at)
            at += len(text)
        while newline >= 0:
            self.lines += [line] * (bisect_left(self.starts, newline) - len(self.lines))
            line, newline = line + 1, content.find("\n", newline + 1)
        self.lines += [line] * (len(self.texts) - len(self.lines))
        self.kinds = [_KINDS[text[0]] for text in self.texts]

    def _lex(self) -> list[tuple[str, str, int, int]]:
        out: list[tuple[str, str, int, int]] = []
        content, pattern, put = self.content, _pattern(self.language), out.append
        at, line, newline = 0, 1, self.content.find("\n")
        while at >= 0:
            # begun anew behind a comment or a text that a pattern doesn't end
            for found in pattern.finditer(content, at):
                kind, begin = found.lastgroup, found.start()
                while 0 <= newline < begin:
                    line += 1
                    newline = content.find("\n", newline + 1)
                if kind == "word" or kind == "mark" or kind == "number":
                    put((kind, found[0], begin, line))
                elif kind == "block":
                    at = self._block_end(begin)
                    if at < 0:
                        self._wrong(line, "a comment isn't closed")
                    break
                elif kind == "open":
                    self._wrong(line, "a text isn't closed")
                    at = -1 if len(found[0]) == 3 or found[0] == "`" or self.language == "rust" else content.find("\n", begin)
                    break
                elif kind not in ("comment", "label"):
                    own = found[0].lstrip() if kind == "text" or kind == "hashes" else found[0]
                    kind = "text" if kind == "hashes" else kind
                    put((kind, own, found.end() - len(own), line + found[0][: len(found[0]) - len(own)].count("\n")))
            else:
                break
        return out

    def _block_end(self, begin: int) -> int:
        if not self.rules.nested:
            end = self.content.find("*/", begin + 2)
            return end + 2 if end >= 0 else -1
        depth = 0
        for mark in re.finditer(r"/\*|\*/", self.content[begin:]):
            depth += 1 if mark[0] == "/*" else -1
            if not depth:
                return begin + mark.end()
        return -1

    def _wrong(self, line: int, what: str) -> None:
        if self.problem is None or line < self.problem[0]:
            self.problem = (line, what)

    def _match(self) -> None:
        """The partner of each bracket (of an open one the end), and the depth before each token."""
        self.match, self.depth = [self.size] * self.size, []
        texts, kinds, match, depth, held, level = self.texts, self.kinds, self.match, self.depth, [], 0
        for i in [i for i, text in enumerate(texts) if text in _BRACKETS]:
            if kinds[i] != "mark":
                continue
            text = texts[i]
            if text in _CLOSES:
                depth += [level] * (i + 1 - len(depth))
                held.append(i)
                level += 1
            elif held and _CLOSES[texts[held[-1]]] == text:
                depth += [level] * (i + 1 - len(depth))
                opened = held.pop()
                level -= 1
                match[opened], match[i] = i, opened
            else:
                self._wrong(self.lines[i], f"{text} closes nothing")
        depth += [level] * (self.size - len(depth))
        if held:
            self._wrong(self.lines[held[-1]], f"{texts[held[-1]]} isn't closed")

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.size else ""

    def word(self, i: int) -> bool:
        return 0 <= i < self.size and self.words[i]

    def beyond(self, i: int) -> int:
        """The index after token ``i``, or after its closing bracket."""
        return self.match[i] + 1 if self.text(i) in ("(", "[", "{") else i + 1

    def angles(self, i: int) -> int:
        """The index after ``<...>`` at ``i``; ``i`` itself if there is none."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < self.size and self.text(j) not in (";", "{", "}"):
            depth += {"<": 1, ">": -1}.get(self.text(j), 0)
            j = self.beyond(j)
            if not depth:
                return j
        return i

    def path(self, i: int) -> tuple[int, str]:
        """Where the dotted path that ends in word ``i`` begins, and its text."""
        j = i
        while self.text(j - 1) in _BEFORE_NAMES and self.word(j - 2):
            j -= 2
        if j == i:
            return i, self.text(i)
        return j, "".join(self.text(k) for k in range(j, i + 1))


class Reader:
    """Reads definitions and references of one source."""

    def __init__(self, source: Source) -> None:
        self.s, self.rules, self.lang = source, source.rules, source.language
        self.control = CONTROL[source.language]
        self.symbols: list[dict] = []
        self.references: list[dict] = []
        self.aliases: dict[str, str] = {}
        self.open: list[tuple[int, int]] = []  # symbol and the index at which it ends
        self.taken: set[int] = set()  # tokens that are names of definitions or parts of imports and headers

    # -- what is found

    def define(self, first: int, name: str, kind: str, last: int, nest: bool = True) -> None:
        s = self.s
        end = min(last, s.size - 1)
        around = self.open[-1][0] if self.open else None
        self.symbols.append({"name": name, "kind": kind, "depth": len(self.open), "first_line": s.lines[first], "last_line": s.lines[end] + s.texts[end].count("\n"), "start": s.starts[first], "stop": s.stop(end), "enclosing": around})
        if nest:
            self.open.append((len(self.symbols) - 1, last))

    def refer(self, i: int, name: str, kind: str, qualified: str | None = None, target: str | None = None) -> None:
        s, start = self.s, self.s.starts[i]
        self.references.append({"name": name, "kind": kind, "first_line": s.lines[i], "start": start, "stop": start + len(s.texts[i]), "enclosing": self.open[-1][0] if self.open else None, "qualified": qualified or name, "target": target})

    def imported(self, i: int, name: str, alias: str | None = None) -> None:
        self.refer(i, name, "import")
        if alias and alias not in ("_", name):
            self.aliases[alias] = name

    # -- statements

    def statement_end(self, i: int) -> int:
        """The last index of the statement at ``i``: its semicolon, or where a line ends it."""
        s, j = self.s, i
        while j < s.size:
            if s.text(j) == ";":
                return j
            if s.text(j) in (")", "]", "}"):
                return j - 1
            if j > i and self.rules.lines and s.lines[j] > s.lines[j - 1] and s.text(j - 1) not in (",", "=", "=>", "->", "(", "+", "-", "&&", "||", ".", ":") and s.text(j) not in (".", "?.", "{", "&&", "||", "=>", "+", "=", "where", "extends", "implements"):
                return j - 1
            j = s.beyond(j)
        return s.size - 1

    def body(self, i: int) -> tuple[int | None, int]:
        """From ``i`` on: the index of the body's opening brace if there is one, and the last index."""
        s, j = self.s, i
        while j < s.size:
            if s.text(j) == "{":
                return j, s.match[j]
            if s.text(j) in (";", ")", "]", "}") or (s.text(j) == "=" and self.lang != "rust"):
                break
            if j > i and self.rules.lines and s.lines[j] > s.lines[j - 1] and s.word(j) and s.text(j) not in ("where", "extends", "implements", "throws"):
                return None, j - 1
            j = s.angles(j) if s.text(j) == "<" and s.angles(j) > j else s.beyond(j)
        if s.text(j) == "=":
            return None, self.statement_end(j)
        return None, min(j, s.size - 1) if s.text(j) == ";" else min(j, s.size) - 1

    # -- imports

    def group(self, i: int, stop: int, head: str) -> None:
        """``a::{b as c, d::{e}}`` between ``i`` and ``stop``, each name with all that stands before it."""
        s, name, at = self.s, head, i
        while at < stop:
            t = s.text(at)
            if t == "{":
                self.group(at + 1, min(s.match[at], stop), name)
                name, at = "", s.match[at] + 1
                continue
            if t == ",":
                if name and name != head:
                    self.imported(at - 1, name.removesuffix("::self"))
                name = head
            elif t == "as" and s.word(at + 1):
                self.imported(at - 1, name.removesuffix("::self"), s.text(at + 1))
                name, at = "", at + 1
            else:
                name += t
            at += 1
        if name and name != head:
            self.imported(stop - 1, name.removesuffix("::self"))

    def imports(self, i: int) -> int:
        """Reads an import at ``i`` if there is one; the index behind it, else ``i``."""
        s, t, lang = self.s, self.s.texts[i], self.lang
        if t not in _IMPORTS.get(lang, ()) or s.text(i - 1) in _BEFORE_NAMES:
            return i
        if lang in ("c", "cpp") and t == "#" and s.text(i + 1) == "include":
            rest = s.content[s.stop(i + 1) :].split("\n", 1)[0].strip()
            found = re.match(r'<([^>]*)>|"([^"]*)"', rest)
            if found:
                self.imported(i, found[1] or found[2])
            j = i
            while j < s.size and s.lines[j] == s.lines[i]:
                j += 1
            return j
        if lang in ("javascript", "typescript") and t == "require" and s.text(i + 1) == "(" and s.text(i + 2)[:1] in "\"'" and s.text(i + 2):
            self.imported(i, s.text(i + 2)[1:-1])
            return s.match[i + 1] + 1
        if lang == "ruby" and t in ("require", "require_relative") and s.text(i + 1)[:1] in ('"', "'"):
            self.imported(i, s.text(i + 1)[1:-1])
            return i + 2
        if t in ("#", "require", "require_relative") or (lang == "csharp" and s.text(i + 1) in ("(", "var")) or s.text(i + 1) in ("(", "function") and lang != "go":
            return i
        if lang == "go" and s.text(i + 1) == "(":
            stop = s.match[i + 1]
            for j in range(i + 2, min(stop, s.size)):
                if s.kinds[j] == "text":
                    self.imported(j, s.text(j)[1:-1], s.text(j - 1) if s.word(j - 1) else None)
            return stop + 1
        stop = self.statement_end(i)
        stop += s.text(stop) != ";"
        inside = range(i + 1, stop)
        texts = [j for j in inside if s.kinds[j] == "text"]
        if lang in ("go", "dart"):
            for j in texts[:1]:
                alias = s.text(j - 1) if lang == "go" and s.word(j - 1) and j - 1 > i else s.text(j + 2) if s.text(j + 1) == "as" else None
                self.imported(j, s.text(j)[1:-1], alias)
        elif lang in ("javascript", "typescript"):
            for j in texts[-1:]:
                self.imported(j, s.text(j)[1:-1])
            for j in inside:
                if s.word(j) and s.depth[j] > s.depth[i] and s.text(j - 1) != "as" and s.text(j) not in ("as", "type"):
                    self.imported(j, s.text(j), s.text(j + 2) if s.text(j + 1) == "as" else None)
        elif lang == "rust":
            self.group(i + 1, stop, "")
        else:
            names = [j for j in inside if s.text(j) not in ("static", "namespace", "function", "const")]
            sign = next((j for j in names if s.text(j) in ("as", "=")), None)
            if lang == "php" and any(s.text(j) == "{" for j in names):
                self.group(names[0], stop, "")
            elif sign is not None and s.text(sign) == "=":
                self.imported(i, "".join(s.text(j) for j in names if j > sign), s.text(sign - 1))
            else:
                self.imported(i, "".join(s.text(j) for j in names if sign is None or j < sign), s.text(sign + 1) if sign is not None else None)
        return stop + (s.text(stop) == ";")

    # -- definitions

    def heritage(self, i: int, stop: int, name: str) -> None:
        """What the class ``name`` extends, in its header between ``i`` and ``stop``."""
        s, on = self.s, False
        while i < stop:
            t = s.text(i)
            if t in self.rules.heritage:
                on = True
            elif on and s.word(i) and t not in ("public", "private", "protected", "virtual", "where"):
                while s.text(i + 1) in _BEFORE_NAMES and s.word(i + 2):
                    self.taken.add(i)
                    i += 2
                self.refer(i, s.text(i), "implements", s.path(i)[1], name)
                self.taken.add(i)
                i = s.angles(i + 1) - 1
            elif t == "where":
                break
            i = s.angles(i) if t == "<" and s.angles(i) > i else s.beyond(i)

    def implementation(self, i: int) -> bool:
        """``impl Trait for Type``: a symbol, and what implements what."""
        s = self.s
        brace, last = self.body(i + 1)
        if brace is None:
            return False
        names, j, at_for = [], s.angles(i + 1), None
        while j < brace and s.text(j) != "where":
            if s.text(j) == "for":
                at_for = len(names)
            elif s.word(j):
                names.append(j)
                self.taken.add(j)
            j = s.angles(j) if s.text(j) == "<" and s.angles(j) > j else j + 1
        if not names:
            return False
        owner = s.text(names[-1])
        self.define(i, f"impl {s.text(names[at_for - 1])} for {owner}" if at_for else f"impl {owner}", "impl", last)
        if at_for:
            self.refer(names[at_for - 1], s.text(names[at_for - 1]), "implements", s.path(names[at_for - 1])[1], owner)
        return True

    def definition(self, i: int) -> bool:
        """Defines what begins with keyword or bare name ``i``."""
        s, t = self.s, self.s.text(i)
        if not s.word(i) or (s.text(i - 1) in _BEFORE_NAMES and (self.lang, s.text(i - 1)) != ("cpp", "::")):
            return False
        kind = self.rules.definitions.get(t)
        around = self.symbols[self.open[-1][0]]["kind"] if self.open else None
        if kind == "impl" and self.lang == "rust":
            return self.implementation(i)
        if t in self.rules.variables:
            return self.variable(i, around)
        if kind is None:
            return self.bare(i, around)
        name = i + 1
        if t == "enum" and s.text(name) in ("class", "struct") or t == "macro_rules":
            name += 1
        if self.lang == "go" and t == "func" and s.text(name) == "(":
            owner = [j for j in range(name + 1, min(s.match[name], s.size)) if s.word(j)]
            self.taken.update(owner)
            name, kind = s.match[name] + 1, "method"
        if not s.word(name) or s.text(name) in (*self.rules.heritage, "for", "if", "in", "is") or (self.lang in ("c", "cpp") and kind in ("struct", "enum", "class") and s.text(name + 1) not in ("{", ":", ";", "final")):
            return False
        if self.lang == "kotlin" and t == "fun" and s.text(name + 1) == ".":
            name += 2
        if kind == "function" and around in _LIKE_CLASSES - {"module"}:
            kind = "method"
        if self.lang == "go" and t == "type":
            kind = {"struct": "struct", "interface": "interface"}.get(s.text(name + 1), "type")
        named = s.text(name)
        while kind == "module" and s.text(name + 1) in _BEFORE_NAMES and s.word(name + 2):
            self.taken.add(name)
            named += s.text(name + 1) + s.text(name + 2)
            name += 2
        brace, last = self.body(name + 1)
        if kind == "type" and brace is not None and self.lang in ("typescript", "kotlin", "swift"):
            brace = None
        self.taken.add(name)
        self.define(i, named, kind, last)
        if kind == "enum" and brace is not None:  # its members are no uses of types
            self.taken.update(j for j in range(brace + 1, min(s.match[brace], s.size)) if s.word(j) and s.depth[j] == s.depth[brace] + 1 and s.text(j - 1) in ("{", ",", ";", "case"))
        if kind in _LIKE_CLASSES:
            self.heritage(name + 1, brace if brace is not None else last, s.text(name))
        return True

    def variable(self, i: int, around: str | None) -> bool:
        """Constants and variables of files and classes (in Rust of functions too)."""
        s, kind = self.s, self.rules.variables[self.s.text(i)]
        if around not in (None, *_LIKE_CLASSES) and self.lang != "rust":
            return False
        if self.lang == "go" and s.text(i + 1) == "(":
            stop = s.match[i + 1]
            for j in range(i + 2, min(stop, s.size)):
                if s.word(j) and s.depth[j] == s.depth[i] + 1 and s.lines[j] > s.lines[j - 1]:
                    self.taken.add(j)
                    self.define(j, s.text(j), kind, max(j, self.statement_end(j)), nest=False)
            return True
        if self.lang in ("java", "csharp"):
            end = self.statement_end(i)
            sign = next((j for j in range(i, end) if s.text(j) == "="), None)
            if sign is None or (self.lang == "java" and "static" not in (s.text(i - 1), s.text(i - 2), s.text(i + 1))):
                return False
            self.taken.add(sign - 1)
            self.define(i, s.text(sign - 1), kind, end, nest=False)
            return True
        name = i + 1 + (s.text(i + 1) == "mut")
        if s.text(name) == "fn" or not s.word(name):  # const fn
            return False
        if self.lang == "php" and not s.text(name + 1) == "=":
            name += 1
        end = self.statement_end(name)
        sign = next((j for j in range(name, min(end, name + 40)) if s.text(j) == "="), None)
        called = sign is not None and self.lang in ("javascript", "typescript") and (s.text(sign + 1) in ("function", "async") or (s.text(sign + 1) == "(" and "=>" in (s.text(s.beyond(sign + 1)), *(s.text(j) for j in range(s.beyond(sign + 1), min(end, s.beyond(sign + 1) + 6))))) or s.text(sign + 2) == "=>")
        self.taken.add(name)
        self.define(i, s.text(name), "function" if called else kind, end, nest=called)
        return True

    def bare(self, i: int, around: str | None) -> bool:
        """A function without a keyword: name, brackets, perhaps words, body."""
        s = self.s
        declared = around == "interface" and self.lang in ("go", "typescript")
        if not (self.rules.bare or declared) or s.text(i) in self.control:
            return False
        opened = s.angles(i + 1)
        if s.text(opened) != "(" or s.match[opened] >= s.size or (around not in _LIKE_CLASSES and (self.rules.bare == "class" or around is not None)):
            return False
        if around is not None and s.depth[i] != self.symbols[self.open[-1][0]].get("inside"):
            return False
        if declared:
            self.taken.add(i)
            self.define(i, s.text(i), "method", self.statement_end(s.match[opened]))
            return True
        head = s.path(i)[0]
        before = s.text(head - 1)
        if around is None and not (s.word(head - 1) and before not in ("return", "else", "new") or before in ("*", "&", ">", "::", "~")):
            return False
        j = s.match[opened] + 1
        while s.word(j) or s.text(j) in (":", ",", "->", ".", "[", "]", "<", ">", "|", "::") or (s.text(j) == "(" and self.lang == "cpp"):
            if s.text(j) == ":" and self.lang not in ("typescript", "cpp", "dart"):
                return False
            j = s.beyond(j)
        ends = s.text(j) == "=>" and self.lang in ("csharp", "dart") or (s.text(j) == ";" and around in ("interface", "class") and self.lang in ("java", "csharp", "typescript"))
        if s.text(j) != "{" and not ends:
            return False
        first = i
        while first and s.lines[first - 1] == s.lines[i] and s.text(first - 1) not in (";", "{", "}", ")"):
            first -= 1
        self.taken.add(i)
        self.define(first, s.text(i), "method" if around else "function", self.statement_end(j) if ends else s.match[j])
        return True

    # -- references

    def use(self, i: int) -> None:
        s, texts = self.s, self.s.texts
        t, after = texts[i], texts[i + 1] if i + 1 < s.size else ""
        if self.lang == "rust" and after == "!" and s.text(i + 2) in ("(", "[", "{"):
            return self.refer(i, t, "macro")
        opened = i + 1
        if after == "::" and s.text(i + 2) == "<":
            opened = s.angles(i + 2)
        elif after == "<" and s.text(s.angles(i + 1)) == "(" and (self.lang != "rust" and self.rules.types):
            opened = s.angles(i + 1)
        before = texts[i - 1] if i else ""
        if (after if opened == i + 1 else s.text(opened)) == "(" and (t not in self.control or before in _BEFORE_NAMES):
            return self.refer(i, t, "call", s.path(i)[1] if before in _BEFORE_NAMES else t)
        if before == "new" and self.lang != "rust":
            return self.refer(i, t, "call")
        if self.rules.types and t[:1].isupper() and before not in (".", "@") and self.lang != "python":
            if not (t.isupper() and "_" in t):
                self.refer(i, t, "type", s.path(i)[1])
        return None

    def values(self) -> None:
        """Uses of the file's own constants, where nothing else was found."""
        s = self.s
        own = {x["name"] for x in self.symbols if x["kind"] == "constant" or (x["kind"] == "variable" and x["name"].isupper())}
        if not own:
            return
        types = {r["start"] for r in self.references if r["kind"] != "type"}
        around = sorted((x["start"], -x["stop"], n) for n, x in enumerate(self.symbols) if x["kind"] not in ("constant", "variable"))
        self.references = [r for r in self.references if r["kind"] != "type" or r["name"] not in own]
        at, held = 0, []
        for i, text in enumerate(s.texts):
            if text not in own:
                continue
            start = s.starts[i]
            while at < len(around) and around[at][0] <= start:
                while held and -held[-1][1] <= around[at][0]:
                    held.pop()
                held.append(around[at])
                at += 1
            while held and -held[-1][1] <= start:
                held.pop()
            if s.words[i] and i not in self.taken and start not in types and s.text(i - 1) not in _BEFORE_NAMES - {"::"}:
                self.refer(i, text, "value", s.path(i)[1])
                self.references[-1]["enclosing"] = held[-1][2] if held else None

    # -- ways through a file

    def braces(self) -> None:
        s, i, starts = self.s, 0, _IMPORTS.get(self.lang, ())
        texts, words, taken = s.texts, s.words, self.taken
        while i < s.size:
            while self.open and i > self.open[-1][1]:
                self.open.pop()
            t = texts[i]
            if t == "{" and self.open:
                self.symbols[self.open[-1][0]].setdefault("inside", s.depth[i] + 1)
            if i in taken:
                i += 1
                continue
            behind = self.imports(i) if t in starts else i
            if behind > i:
                taken.update(range(i, behind))
                i = behind
                continue
            if words[i] and not self.definition(i):
                self.use(i)
            i += 1

    def indents(self) -> None:
        """Python: a line that begins outside brackets ends all blocks that aren't above it."""
        s, blocks, i = self.s, [], 0
        texts, words, lines, definitions = s.texts, s.words, s.lines, self.rules.definitions
        while i < s.size:
            t = texts[i]
            leads = i == 0 or (lines[i] != lines[i - 1] and lines[i] > lines[i - 1] + texts[i - 1].count("\n"))
            if not leads and (not words[i] or (t not in definitions and not t[0].isupper() and texts[i - 1] != "new" and (i + 1 == s.size or texts[i + 1] not in ("(", "<", "::")))):
                i += 1  # neither a definition nor a use
                continue
            if leads and not s.depth[i] and s.text(i - 1) != "\\":
                column = s.starts[i] - (s.content.rfind("\n", 0, s.starts[i]) + 1)
                while blocks and column <= blocks[-1]:
                    blocks.pop()
                    self.close(self.open.pop()[0], i - 1)
                if i not in self.taken and t in ("import", "from"):
                    i = self.python_import(i)
                    continue
                if not self.open and s.word(i) and s.text(i + 1) in ("=", ":") and t not in self.control:
                    self.define(i, t, "constant" if t.isupper() else "variable", self.line_end(i), nest=False)
                    self.taken.add(i)
            if t in definitions and words[i] and s.word(i + 1) and s.text(i - 1) != ".":
                head = i
                while s.text(head - 1) == "async":
                    head -= 1
                column = s.starts[head] - (s.content.rfind("\n", 0, s.starts[head]) + 1)
                kind = definitions[t]
                if kind == "function" and self.open and self.symbols[self.open[-1][0]]["kind"] == "class":
                    kind = "method"
                self.define(head, s.text(i + 1), kind, s.size - 1)
                blocks.append(column)
                self.taken.add(i + 1)
                if kind == "class" and s.text(i + 2) == "(":
                    for j in range(i + 3, min(s.match[i + 2], s.size)):
                        if s.word(j) and s.depth[j] == s.depth[i] + 1 and s.text(j + 1) not in (".", "=") and s.text(j - 1) != "=":
                            self.refer(j, s.text(j), "implements", s.path(j)[1], s.text(i + 1))
                            self.taken.update(range(s.path(j)[0], j + 1))
            elif words[i] and i not in self.taken:
                self.use(i)
                if t[:1].isupper() and (s.text(i - 1) in (":", "->") or (s.text(i - 1) == "[" and s.depth[i])) and s.text(i + 1) not in ("(", "."):
                    self.refer(i, t, "type")
            i += 1
        while self.open:
            self.close(self.open.pop()[0], s.size - 1)

    def close(self, symbol: int, last: int) -> None:
        s = self.s
        self.symbols[symbol].update(last_line=s.lines[last] + s.texts[last].count("\n"), stop=s.stop(last))

    def line_end(self, i: int) -> int:
        s, j = self.s, i
        while j + 1 < s.size and (s.lines[j + 1] == s.lines[j] or s.depth[j + 1]):
            j += 1
        return j

    def python_import(self, i: int) -> int:
        s, stop = self.s, self.line_end(i) + 1
        head, j = "", i + 1
        if s.text(i) == "from":
            while j < stop and s.text(j) != "import":
                head, j = head + s.text(j), j + 1
            if head.strip("."):
                self.imported(i, head)
            head += "" if head.endswith(".") else "."
            j += 1
        name = ""
        while j <= stop:
            t = s.text(j) if j < stop else ","
            if t == "as":
                self.imported(j - 1, head + name, s.text(j + 1))
                name, j = "", j + 1
            elif t == ",":
                if name:
                    self.imported(j - 1, head + name)
                name = ""
            elif t not in ("(", ")"):
                name += t
            j += 1
        self.taken.update(range(i, stop))
        return stop

    def ends(self) -> None:
        """Ruby: words that open a block, and ``end``."""
        s, held, i = self.s, [], 0
        while i < s.size:
            t = s.texts[i]
            leads = i == 0 or s.lines[i] > s.lines[i - 1] or s.text(i - 1) in (";", "=")
            behind = self.imports(i)
            if behind > i:
                self.taken.update(range(i, behind))
                i = behind
                continue
            if s.words[i] and s.text(i - 1) != ":":
                if s.text(i - 1) in (".", "::"):
                    self.use(i)
                elif t in self.rules.definitions and leads and s.word(i + 1):
                    name = i + 1
                    while s.text(name + 1) in (".", "::") and s.word(name + 2):
                        name += 2
                    kind = self.rules.definitions[t]
                    if kind == "function" and self.open and self.symbols[self.open[-1][0]]["kind"] in _LIKE_CLASSES:
                        kind = "method"
                    self.define(i, s.text(name), kind, s.size - 1)
                    held.append(True)
                    self.taken.update(range(i + 1, name + 1))
                    if s.text(name + 1) == "<" and s.word(name + 2):
                        self.refer(name + 2, s.text(name + 2), "implements", None, s.text(name))
                        self.taken.add(name + 2)
                elif (t in ("if", "unless", "while", "until", "case", "begin", "for") and leads) or (t == "do" and not any(s.text(j) in ("while", "until", "for") for j in range(max(0, i - 12), i) if s.lines[j] == s.lines[i])):
                    held.append(False)
                elif t == "end":
                    if not held:
                        s._wrong(s.lines[i], "end closes nothing")
                    elif held.pop():
                        self.close(self.open.pop()[0], i)
                elif i not in self.taken:
                    self.use(i)
                    if t.isupper() and leads and s.text(i + 1) == "=":
                        self.define(i, t, "constant", self.line_end(i), nest=False)
                        self.taken.add(i)
            i += 1
        if held:
            s._wrong(s.lines[-1], "a block isn't ended")

    def read(self) -> None:
        {"python": self.indents, "ruby": self.ends}.get(self.lang, self.braces)()
        self.open = []
        self.values()


class Page(HTMLParser):
    """Elements, template names, control blocks and links of HTML."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    OPTIONAL = frozenset("html head body p li dt dd option optgroup thead tbody tfoot tr td th colgroup rp rt".split())

    def __init__(self, content: str) -> None:
        super().__init__(convert_charrefs=True)
        self.symbols: list[dict] = []
        self.references: list[dict] = []
        self.held: list[tuple[str, int | None]] = []
        self.problem: tuple[int, str] | None = None
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        self.feed(content)
        self.close()
        left = next(((t, n) for t, n in self.held if t not in self.OPTIONAL), None)
        if left:
            self.problem = self.problem or (self.getpos()[0], f"<{left[0]}> isn't closed")

    def _at(self) -> tuple[int, int]:
        line, column = self.getpos()
        return line, self.starts[line - 1] + column

    def _symbol(self, name: str, kind: str) -> int:
        line, start = self._at()
        around = next((n for _, n in reversed(self.held) if n is not None), None)
        self.symbols.append({"name": name, "kind": kind, "depth": len(self.held), "first_line": line, "last_line": line, "start": start, "stop": start, "enclosing": around})
        return len(self.symbols) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = None
        if not self.held or "-" in tag:
            own = self._symbol(tag, "other")
        for name, value in attrs:
            if name.startswith("#") and len(name) > 1:
                self._symbol(name[1:], "variable")
            if (tag, name) in (("script", "src"), ("link", "href"), ("img", "src"), ("iframe", "src"), ("a", "href")) and value:
                line, start = self._at()
                around = own if own is not None else next((n for _, n in reversed(self.held) if n is not None), None)
                self.references.append({"name": value, "kind": "value" if tag == "a" else "import", "first_line": line, "start": start, "stop": start, "enclosing": around, "qualified": value, "target": tag})
        if tag not in self.VOID:
            self.held.append((tag, own))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID and self.held:
            self.held.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.held) - 1, -1, -1) if self.held[i][0] == tag), None)
        if at is None:
            if tag not in self.OPTIONAL and tag not in self.VOID:
                self.problem = self.problem or (self.getpos()[0], f"</{tag}> closes nothing")
            return
        line, start = self._at()
        for open_tag, own in self.held[at:]:
            if own is not None:
                self.symbols[own].update(last_line=line, stop=start + len(tag) + 3)
            if open_tag != tag and open_tag not in self.OPTIONAL:
                self.problem = self.problem or (line, f"<{open_tag}> isn't closed")
        del self.held[at:]

    def handle_data(self, data: str) -> None:
        if self.held and self.held[-1][0] in ("script", "style"):
            return
        for found in re.finditer(r"@(if|for|switch|defer)\b|@let\s+([A-Za-z_$][\w$]*)\s*=", data):
            self._symbol(found[2] or f"@{found[1]}", "variable" if found[2] else "module")


#: All kinds of records.
RECORDS = ("symbol", "reference", "alias", "status")


def read(language: str | None, content: str | None, records: Collection[str] = RECORDS, digests: bool = True) -> list[dict]:
    """The records of one file, of the kinds given; symbols' digests only if asked for."""
    told = {"record": "status", "name": language}
    wanted = lambda r: [r] if "status" in records else []
    if content is None:
        return wanted(told | {"kind": "failed", "target": "no content"})
    if language not in LANGUAGES and language != "html":
        return wanted(told | {"kind": "unsupported"})
    if language == "html":
        found, aliases = Page(content), {}
        problem = found.problem
    else:
        source = Source(language, content)
        found = Reader(source)
        if source.size:
            found.read()
        problem, aliases = source.problem, found.aliases
    out = []
    if "symbol" in records:
        for n, s in enumerate(found.symbols):
            s["record"], s["ordinal"] = "symbol", n
            if digests:
                s["digest"] = sha256(content[s["start"] : s["stop"]].encode("utf-8", "replace")).hexdigest()
        out += found.symbols
    if "reference" in records:
        for r in found.references:
            r["record"] = "reference"
        out += sorted(found.references, key=lambda r: (r["start"], r["kind"]))
    for r in out:
        if r["enclosing"] is not None:
            own = found.symbols[r["enclosing"]]
            r["around"], r["around_kind"] = own["name"], own["kind"]
    if "alias" in records:
        out += [{"record": "alias", "name": a, "target": o} for a, o in aliases.items()]
    state = {"kind": "processed"} if problem is None else {"kind": "partial", "target": problem[1], "first_line": problem[0]}
    return [*out, *wanted(told | state)]


def _rows(language: str | None, content: str | None) -> Iterator[tuple]:
    for r in read(language, content):
        yield tuple(map(r.get, _FIELDS))


def _schema(columns: Iterable[str]) -> pa.Schema:
    types = {f.split()[0]: pa.string() if f.endswith("string") else pa.int32() for f in FACTS.split(", ")}
    return pa.schema([("path", pa.string()), *((c, types[c]) for c in columns)])


def _batches(batches: Iterator[pa.RecordBatch], records: Collection[str], columns: Iterable[str] = _FIELDS) -> Iterator[pa.RecordBatch]:
    """Records of files (path, language, content) in stretches of ``STRETCH`` rows, however many files a batch holds."""
    schema = _schema(columns)
    shapes = Shapes(read, LANGUAGES, records, schema.names[1:])
    held: list[list] = [[] for _ in schema]

    def passed(n: int) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c[:n], type=f.type) for c, f in zip(held, schema, strict=True)], schema=schema)
        for c in held:
            del c[:n]
        return out

    for b in batches:
        for path, lang, content in zip(*_texts(b), strict=True):
            found = shapes.columns(lang, content)
            held[0] += [path] * len(found[0])
            for c, values in zip(held[1:], found, strict=True):
                c += values
            while len(held[0]) >= STRETCH:
                yield passed(STRETCH)
    if held[0]:
        yield passed(len(held[0]))


def _texts(batch: pa.RecordBatch) -> list[Iterator[str | None]]:
    # of long texts one at a time, so that they aren't all held twice
    if batch.nbytes <= SHORT:
        return [iter(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
    return [(v.as_py() for v in c) for c in batch.columns]


def extract(files: DataFrame, id_col: str = "path", records: Collection[str] = RECORDS, columns: Collection[str] = _FIELDS) -> DataFrame:
    """Rows of all records (path, record, ...), or of those kinds and columns that are asked for, of files (path, language, content); each file is parsed once.

    A core reads some 500 KB a second, so files should come in partitions of a few MB.
    """
    kinds, names = frozenset(records), ["record", *(c for c in _FIELDS if c in columns and c != "record")]
    types = dict(f.split() for f in FACTS.split(", "))
    return files.select(F.col(id_col).cast("string").alias("path"), "language", "content").mapInArrow(lambda batches: _batches(batches, kinds, names), ", ".join(["path string", *(f"{c} {types[c]}" for c in names)]))


@udtf(returnType=FACTS)
class SourceFacts:
    """The same as a table function: ``LATERAL source_facts(language, content)``."""

    def eval(self, language: str, content: str) -> Iterator[tuple]:
        yield from _rows(language, content)


def register(spark: SparkSession) -> None:
    """Makes ``source_facts`` known to SQL."""
    spark.udtf.register("source_facts", SourceFacts)


def _known(facts: DataFrame, record: str, columns: dict[str, str]) -> DataFrame:
    """One kind of record; columns that weren't extracted are null."""
    types = {"path": "string", **dict(f.split() for f in FACTS.split(", "))}
    return facts.where(F.col("record") == record).select(*[(F.col(c) if c in facts.columns else F.lit(None).cast(types[c])).alias(n) for c, n in columns.items()])


def symbols(facts: DataFrame) -> DataFrame:
    return _known(facts, "symbol", {c: c for c in "path ordinal name kind depth first_line last_line start stop enclosing digest around".split()})


def references(facts: DataFrame) -> DataFrame:
    return _known(facts, "reference", {"path": "path", "name": "name", "kind": "kind", "first_line": "line", "enclosing": "enclosing", "qualified": "qualified", "target": "target", "around": "around", "around_kind": "around_kind"})


def aliases(facts: DataFrame) -> DataFrame:
    return facts.where("record = 'alias'").select("path", F.col("name").alias("alias"), F.col("target").alias("original"))


def status(facts: DataFrame) -> DataFrame:
    return facts.where("record = 'status'").select("path", F.col("name").alias("language"), F.col("kind").alias("status"), F.col("target").alias("problem"), F.col("first_line").alias("line"))


def language_of(path: Column) -> Column:
    """The language of a path's extension; null of others."""
    extensions = {"rs": "rust", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "swift": "swift", "php": "php", "dart": "dart", "py": "python", "rb": "ruby", "html": "html", "htm": "html"}
    known = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))

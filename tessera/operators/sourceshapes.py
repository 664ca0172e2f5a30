"""Files that differ only in the digits of their words and numbers, read once for all of them.

What the reader finds depends on classes of characters, on fixed words (none has a
digit) and on which words are equal. So a file's shape is its text without its runs
of digits, and which of these are equal; from the second file of a shape on, the
records of one text with numbered runs are filled with each file's own. A shape whose
records can't be told that way (see :func:`_template`), and a file that may hold a
character in quotes, whose length counts, are read as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate
from operator import itemgetter

_RUN, _RUNS = re.compile("[0-9]+"), re.compile("([0-9]+)")
#: Digits of a numbered run.
_WIDTH = 4
#: Letters of a file, shapes that were seen once, and shapes that are held, at most.
LONGEST, SEEN, HELD = 1 << 13, 1 << 14, 1 << 10
_LENGTH_COUNTS = re.compile(r"['\\][0-9]")
#: Python's blocks go by columns, so no digits may stand before what opens one.
_SHIFTED = re.compile(r"[0-9][^\n]*\b(?:def|class|async)\b")


def _several(n: list[int]) -> Callable:
    """``n``'s places of a list, as a tuple."""
    return itemgetter(*n) if len(n) > 1 else (lambda v, i=n[0]: (v[i],)) if n else (lambda v: ())


@dataclass(frozen=True)
class Template:
    """The records of a shape: ``columns`` that all its files share, or how each file's own come about."""

    size: int
    columns: list[tuple[str, object]]  # ("same", values), ("text", places), ("place", [(place, runs before it)]), ("digest", [(start, stop)])
    text: str
    runs: Callable
    places: bool

    def fill(self, content: str, runs: list[str]) -> list[Iterable]:
        texts = (self.text % self.runs(runs)).split("\0")
        texts.append(None)
        gone = [0, *accumulate(len(r) - _WIDTH for r in runs)] if self.places else ()
        at = lambda p: None if p is None else p[0] + gone[p[1]]
        out = []
        for how, what in self.columns:
            if how == "same":
                out.append(what)
            elif how == "text":
                out.append(what(texts))
            elif how == "place":
                out.append([at(p) for p in what])
            else:
                out.append([None if p is None else sha256(content[at(p[0]) : at(p[1])].encode("utf-8", "replace")).hexdigest() for p in what])
        return out


def _template(records: list[dict], numbered: str, turns: list[int], names: list[str]) -> Template | None:
    """How ``names`` of the records of a text with numbered runs are filled; None if a name or a place parts a run."""
    ends = [m.end() for m in _RUN.finditer(numbered)]
    before = {0: 0, len(numbered): len(ends)}
    for n, m in enumerate(_RUN.finditer(numbered)):
        before |= dict.fromkeys(range(m.end() - _WIDTH + 1, m.end()), None)
    count, at = [0] * (len(numbered) + 1), 0
    for i in range(len(numbered) + 1):
        while at < len(ends) and ends[at] <= i:
            at += 1
        count[i] = at
    first = {turn: n for n, turn in reversed([*enumerate(turns)])}
    texts: list[str] = []
    wanted: list[int] = []
    columns: list[tuple[str, object]] = []

    def place(p: int | None) -> tuple[int, int] | None:
        if p is not None and before.get(p, 0) is None:
            raise ValueError
        return None if p is None else (p, count[p])

    def text(t: str) -> int:
        if any(len(r) % _WIDTH for r in _RUN.findall(t)) or "\0" in t:
            raise ValueError
        wanted.extend(first[int(r)] for r in re.findall(f"[0-9]{{{_WIDTH}}}", t))
        texts.append(re.sub(f"[0-9]{{{_WIDTH}}}", "%s", t.replace("%", "%%")))
        return len(texts) - 1

    try:
        for name in names:
            values = [r.get(name) for r in records]
            if name in ("start", "stop"):
                columns.append(("place", [place(p) for p in values]))
            elif name == "digest":
                columns.append(("digest", [(place(r["start"]), place(r["stop"])) if r["record"] == "symbol" else None for r in records]))
            elif any(isinstance(v, str) and _RUN.search(v) for v in values):
                columns.append(("text", _several([-1 if v is None else text(v) for v in values])))
            else:
                columns.append(("same", values))
    except (ValueError, KeyError):
        return None
    places = any(how in ("place", "digest") for how, _ in columns)
    return Template(len(records), columns, "\0".join(texts), _several(wanted), places)


def _compared(records: list[dict], numbered: str) -> list[int] | None:
    """The runs whose equality counts, of all records of a text whose runs have different numbers; None if a name joins runs."""
    names = {r["name"] for r in records if r["record"] == "alias" or r["record"] == "symbol" and r["kind"] in ("constant", "variable") or r["record"] == "reference" and r["kind"] == "import"}
    out: set[int | None] = set()
    for name in names:
        own = _RUN.findall(name or "")
        if any(len(r) != _WIDTH for r in own):
            return None
        out.update(map(int, own))
    at: list[int | None] = [None] * len(numbered)
    for m in _RUN.finditer(numbered):
        at[m.start() : m.end()] = [int(m[0])] * _WIDTH
    # wherever the same letters stand, whether or not they are a word of their own
    for like in {_RUN.sub("0", name) for name in names if name and _RUN.search(name)}:
        for found in re.finditer(f"(?=({re.escape(like).replace('0', f'[0-9]{{{_WIDTH}}}')}))", numbered):
            # a match may begin or end within a run
            out.update(at[found.start(1) : found.end(1)])
    return sorted(out - {None})


class _Shape:
    """A text without its runs: those whose equality counts, and its records with all runs different; unreadable as a shape without ``records``."""

    def __init__(self, compared: list[int] | None, records: list[dict] | None) -> None:
        self.compared, self.records = compared, records
        self.own = _several(compared or [])

    def turns(self, runs: list[str]) -> tuple[int, ...] | None:
        """Which of the compared runs are equal; None if all differ."""
        own = self.own(runs)
        if len({*own}) == len(own):
            return None
        nth: dict[str, int] = {}
        return tuple([nth.setdefault(r, len(nth)) for r in own])


class Shapes:
    """Records of files as columns ``names``; ``read`` reads one file (language, content, records, digests)."""

    def __init__(self, read: Callable, languages: Iterable[str], records: Iterable[str], names: list[str]) -> None:
        self.read, self.languages, self.records, self.names = read, frozenset(languages), records, names
        self.digests = "digest" in names
        self.seen: set = set()
        self.shapes: dict = {}
        self.held: dict = {}

    def plainly(self, language: str | None, content: str | None) -> list[Iterable]:
        found = self.read(language, content, self.records, self.digests)
        return [[r.get(n) for r in found] for n in self.names]

    def _before(self, key: tuple) -> bool:
        """Whether ``key`` was seen; it is from now on."""
        if key in self.seen:
            return True
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(key)
        return False

    def columns(self, language: str | None, content: str | None) -> list[Iterable]:
        """The columns of one file's records."""
        if content is None or language not in self.languages or len(content) > LONGEST or "\0" in content:
            return self.plainly(language, content)
        if ("'" in content or "\\" in content) and _LENGTH_COUNTS.search(content):
            return self.plainly(language, content)
        parts = _RUNS.split(content)
        runs = parts[1::2]
        key = (language, "0".join(parts[::2]))
        shape = self.shapes.get(key)
        known = shape is not None
        if not known:
            if not self._before(key):
                return self.plainly(language, content)
            if len(self.shapes) >= HELD:
                self.shapes.clear()
            shape = self.shapes[key] = self._shaped(language, parts)
        key = (shape, shape.turns(runs))
        template = self.held.get(key, self)
        if template is self:
            # the first file's own turns weren't looked at
            if known and not self._before(key):
                return self.plainly(language, content)
            template = self._made(language, parts, *key)
            if template is not None and [[*c] for c in template.fill(content, runs)] != self.plainly(language, content):
                template = None
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[key] = template
        return self.plainly(language, content) if template is None else template.fill(content, runs)

    def _numbered(self, parts: list[str], turns: Iterable[int]) -> str:
        numbers = [f"{t:0{_WIDTH}d}" for t in turns]
        return "".join(p if n % 2 == 0 else numbers[n // 2] for n, p in enumerate(parts))

    def _shaped(self, language: str, parts: list[str]) -> _Shape:
        count = len(parts) // 2
        if count >= 10**_WIDTH:
            return _Shape(None, None)
        numbered = self._numbered(parts, range(count))
        if language == "python" and _SHIFTED.search(numbered):
            return _Shape(None, None)
        records = self.read(language, numbered, ("symbol", "reference", "alias", "status"), False)
        compared = _compared(records, numbered)
        return _Shape(compared, None if compared is None else records)

    def _made(self, language: str, parts: list[str], shape: _Shape, turns: tuple[int, ...] | None) -> Template | None:
        if shape.records is None:
            return None
        every = [*range(len(parts) // 2)]
        if turns is None:
            return _template([r for r in shape.records if r["record"] in self.records], self._numbered(parts, every), every, self.names)
        for n, turn in zip(shape.compared, turns, strict=True):
            every[n] = shape.compared[turns.index(turn)]
        numbered = self._numbered(parts, every)
        return _template(self.read(language, numbered, self.records, False), numbered, every, self.names)

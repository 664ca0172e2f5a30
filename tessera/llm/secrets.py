"""Secrets in texts: key patterns, and windows of high entropy.

Patterns find assignments of secrets, access keys and long hexadecimal strings.
Beyond them every run of ``CANDIDATE`` characters is a candidate: a window of
``WINDOW`` characters slides over it, counts per character are kept up to date
as one enters and one leaves, and the Shannon entropy follows from the sum of
c * log2(c). Windows above the limit of the candidate's character class
(hexadecimal, letters and digits of one case, all else) are joined to spans.
An allow-list suppresses words, numbers, UUIDs, digests that say what they are,
paths and addresses. Entropy spans never replace pattern spans: one that touches
a pattern span is left out.

One pass over the texts, no shuffle; memory is that of a batch.

Nulls, ties, repeats: a null or empty text has no spans. Rows come back one for
one with all their columns, ids as they are (null, repeated); columns named like
a new one are replaced. Spans of one kind don't overlap; of one start, kinds come
in the order of ``KINDS``. An empty table gives an empty result. Very long texts
are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._tables import small_batches, widened

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run too short is dropped whole, so the least length may stand in these two patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character that a window must reach, by the candidate's class.
LIMITS = {"hex": 3.0, "alnum": 3.6, "mixed": 3.9}
ALLOWED = re.compile(r"[A-Za-z]+|[0-9]+|[_=+/-]+|(?:[A-Za-z]{1,20}[-_/+=]+)*[A-Za-z]{1,20}[-_/+=]*|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
ALLOWED_BEFORE = re.compile(r"(?:sha1|sha256|sha512|md5|integrity|https?:/|www\.)[:= \"'/-]*$", re.IGNORECASE)
_CLASSES = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+")), ("alnum", re.compile(r"[0-9a-z]+|[0-9A-Z]+")))
_TERM = [0.0, *(c * log2(c) for c in range(1, WINDOW + 2))]  # one more: a character enters before one leaves

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy_runs(candidate: str, limit: float) -> list[tuple[int, int]]:
    """Ranges covered by windows whose entropy reaches the limit, from counts updated one character at a time."""
    seen: dict[str, int] = {}
    total = 0.0
    out: list[list[int]] = []
    for i, c in enumerate(candidate):
        n = seen.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        seen[c] = n + 1
        if i >= WINDOW:
            gone = candidate[i - WINDOW]
            n = seen[gone]
            total += _TERM[n - 1] - _TERM[n]
            seen[gone] = n - 1
        if i >= WINDOW - 1 and log2(WINDOW) - total / WINDOW >= limit:
            if out and i - WINDOW + 1 <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([i - WINDOW + 1, i + 1])
    return [(a, b) for a, b in out]


def entropy_spans(text: str, taken: list[Span]) -> list[Span]:
    """Spans of high entropy that touch none of ``taken``, which come by start."""
    out = []
    begins: list[int] = []  # of the stretches that ``taken`` covers, which lie apart
    stops: list[int] = []
    for _, s, e in taken:
        if stops and s <= stops[-1]:
            stops[-1] = max(stops[-1], e)
        else:
            begins.append(s)
            stops.append(e)
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if ALLOWED.fullmatch(word) or ALLOWED_BEFORE.search(text, max(0, m.start() - 16), m.start()):
            continue
        kind = next((k for k, p in _CLASSES if p.fullmatch(word)), "mixed")
        for a, b in entropy_runs(word, LIMITS[kind]):
            a, b = a + m.start(), b + m.start()
            last = bisect_left(begins, b) - 1  # the last stretch that begins before this span ends
            if last < 0 or stops[last] <= a:
                out.append(("entropy", a, b))
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and these with the entropy spans."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span (overlaps merged) replaced by ``mark``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", *, redact: bool = False) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans; with ``redact`` the text has its secrets replaced."""
    small_batches(docs.sparkSession)
    docs, schema = widened(docs, {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"})
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts = got.column(at).to_pylist()
            rows = [all_spans(t or "") for t in texts]
            numbers = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS[:3]]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            columns = list(got.columns)
            if redact:
                columns[at] = pa.array([t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, rows, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, *numbers, digests, pa.array([joined(s) for _, s in rows], pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)

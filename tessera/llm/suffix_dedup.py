"""Repeated byte strings across documents, by bucket-pointer refinement of sparse suffixes.

A byte goes when it is covered by a string of ``length`` bytes that also starts
earlier (smaller id, or the same document and an earlier start). Strings never
cross documents and are judged on the input.

1. Anchors. Of the q-grams inside every window of ``length`` bytes the one with
   the smallest hash (leftmost of equals) owns the window. Equal windows have
   the same owner at the same offset, so only the suffixes at owners (about 2
   in 86 positions) are compared. Consecutive windows of one owner are one row
   with a hash of all their bytes (the context).
2. Initial buckets. Rows are bucketed by the owner's q-gram. Rows with equal
   contexts repeat each other wholly: all but the first give their bytes up
   (first inside each task, so a passage in a third of all documents arrives as
   a row a task). Buckets with one context are done.
3. Refinement. Of buckets that are left, the contexts' bytes are fetched and
   their suffixes refined: 8-gram buckets, then 16, 32 and 64 bytes by sorting
   on the pair of bucket identifiers at a suffix and at its later offset, each
   level's identifiers reused for the next, at last ``length`` bytes. Singleton
   buckets are left out of later sorts. Windows in one bucket are equal.

Buckets above ``hot`` contexts are not gathered: their windows are named by 128
bits of hash, and a partially aggregated minimum finds the first of each name.

What is exact. Refinement compares bytes. Contexts count as equal when 128 bits
of hash are (64 of the owner's gram, 64 of all their bytes, in an order-sensitive
mixing hash that no structure of a text makes collide); the same holds for the
names of windows in large buckets.

Nulls, ties, repeats: a null text is empty. Rows without an id neither lose
bytes nor make others lose any. Rows that share an id count as one document: the
same start in the same id is no earlier start. Empty tables give empty results.
Extra columns are ignored, but for those asked to be carried. A very long text is
looked at in overlapping pieces of ``PIECE`` bytes, and its repeats are removed
in one task. ``length`` may be 2 to 65,536; others are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import _bytes as B
from tessera.llm._tables import group_starts, runs, small_batches
from tessera.scratch import cut, fewer_files

LENGTH = 100
GRAM = 16
#: Contexts of a bucket that one task may hold (some 150 bytes each, of which refinement takes some sixty times as much).
HOT = 8_192
#: Bytes of a text that are looked at together.
PIECE = 1 << 16
#: Anchor rows combined before they leave a task.
FLUSH = 250_000

#: Bits below a packed start, and those of a packed count when shifted down.
_START, _COUNT = 18, (1 << 17) - 1

_ROWS = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("packed", pa.int64())])
_FOUND = pa.schema([("edge", pa.bool_()), ("fp", pa.int64()), ("doc", pa.int64()), ("packed", pa.int64())])
_SPANS = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _pack(start: np.ndarray, count: np.ndarray, whole: bool) -> np.ndarray:
    """Start of a row's first window, number of its windows, and whether it is a finished span."""
    return (start << _START) | (count << 1) | int(whole)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> _START, (packed >> 1) & _COUNT, (packed & 1).astype(bool)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (at most 16) bytes from each place on that has as many."""
    n = len(data) - gram + 1
    words = np.ascontiguousarray(B.octets(data))
    if gram < 8:
        return B.mix((words[:n] & np.uint64((1 << (8 * gram)) - 1)) + np.uint64(gram))
    first = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    first ^= first >> np.uint64(32)
    first += words[gram - 8 : gram - 8 + n]  # the last eight, which may overlap the first
    first *= np.uint64(0xD1342543DE82EF95)
    return B.mix(first)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Rows of one piece of text: first window, number of windows, hash of the owner's q-gram, and the owner's place in the first window."""
    grams = _grams(data, gram)
    places = np.arange(len(grams), dtype=np.uint64)
    low = (grams & ~np.uint64(0xFFFFF)) | places
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    owner = (low & np.uint64(0xFFFFF)).astype(np.int64)
    at = group_starts(owner)
    first, count = at[:-1], np.diff(at)
    return first, count, grams[owner[first]], owner[first] - first


def context_hash(data: np.ndarray, first: np.ndarray, count: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """A hash of each row's context: all bytes of its windows, and where the owner stands in them."""
    return B.mix(B.slices_hash(data, first, first + count - 1 + length) + (offset.astype(np.uint64) << np.uint64(32)) + count.astype(np.uint64))


def _first_of_class(fp: np.ndarray, ctx: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: which begin a class (fp, ctx), and which repeat the beginner from elsewhere."""
    at = group_starts(fp, ctx)
    begins = np.zeros(len(fp), bool)
    begins[at[:-1]] = True
    head = np.repeat(at[:-1], np.diff(at))
    return begins, (doc != doc[head]) | (start != start[head])


def _anchor_rows(length: int, gram: int):
    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        fp, ctx, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, ctx, fp))
        fp, ctx, doc, start, count = (x[order] for x in (fp, ctx, doc, start, count))
        begins, repeats = _first_of_class(fp, ctx, doc, start)
        keep = begins | repeats
        packed = np.where(begins, _pack(start, count, False), _pack(start, count, True))
        # a finished span needs no bucket: it is dealt out by its place
        fp = np.where(begins, fp, B.mix(doc.astype(np.uint64) + start.astype(np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (fp, np.where(begins, ctx, 0), doc, packed)], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for got in batches:
            data, offsets = B.view(got.column("text"))
            rows: list[tuple[np.ndarray, ...]] = []
            for doc, a, b in zip(got.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for s in range(a, max(b - length + 1, a), PIECE):
                    first, count, fp, offset = anchors(data[s : min(b, s + PIECE + length - 1)], length, gram)
                    rows.append((first + s, count, fp, offset, np.full(len(first), doc, np.int64), np.full(len(first), a, np.int64)))
            if not rows:
                continue
            first, count, fp, offset, doc, begin = (np.concatenate(x) for x in zip(*rows, strict=True))
            ctx = context_hash(data, first, count, offset, length)  # of the whole batch at once
            parts.append((fp.view(np.int64), ctx.view(np.int64), doc, first - begin, count))
            held += len(first)
            if held >= FLUSH:
                yield combined(parts)
                parts, held = [], 0
        if parts:
            yield combined(parts)

    return run


def _repeats(length: int):
    """Of rows sorted by bucket, context, document and start: finished spans, and the contexts of buckets with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the row that began the newest class: fp, ctx, doc, packed
        told = True  # whether it went out (or began nothing)
        for got in batches:
            if not got.num_rows:
                continue
            cols = [got.column(c).to_numpy() for c in ("fp", "ctx", "doc", "packed")]
            extra = 0
            if head is not None:
                cols = [np.append(h, c) for h, c in zip(head, cols, strict=True)]
                extra = 1
            fp, ctx, doc, packed = cols
            start, count, whole = _unpack(packed)
            # finished spans pass through and begin no class
            real = np.flatnonzero(~whole)
            out_fp, out_doc, out_packed, out_edge = [fp[whole]], [doc[whole]], [packed[whole]], [np.zeros(int(whole.sum()), bool)]
            if len(real):
                f, c, d, s, n = fp[real], ctx[real], doc[real], start[real], count[real]
                begins, repeats = _first_of_class(f, c, d, s)
                out_fp.append(f[repeats])
                out_doc.append(d[repeats])
                out_packed.append(_pack(s[repeats], n[repeats], True))
                out_edge.append(np.zeros(int(repeats.sum()), bool))
                b = np.flatnonzero(begins)
                near = np.zeros(len(b), bool)
                near[1:] |= f[b][1:] == f[b][:-1]
                near[:-1] |= f[b][:-1] == f[b][1:]
                if extra and told and head is not None and real[0] == 0:
                    near_out = near.copy()
                    near_out[0] = False
                else:
                    near_out = near
                out_fp.append(f[b][near_out])
                out_doc.append(d[b][near_out])
                out_packed.append(packed[real][b][near_out])
                out_edge.append(np.ones(int(near_out.sum()), bool))
                last = b[-1]
                was_head = extra and real[last] == 0
                told = bool(near[-1]) or (bool(was_head) and told)
                head = tuple(x[real][last : last + 1] for x in (fp, ctx, doc, packed))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_edge, out_fp, out_doc, out_packed)], schema=_FOUND)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return started


_CONTEXTS = pa.schema([("fp", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            fps, docs, starts, pieces = [], [], [], []
            data, offsets = B.view(got.column("text"))
            for doc, a, b, edges in zip(got.column("id").to_pylist(), offsets[:-1], offsets[1:], got.column("edges").to_pylist(), strict=True):
                for e in edges:
                    start, count = e["packed"] >> _START, (e["packed"] >> 1) & _COUNT
                    piece = data[a + start : min(b, a + start + count - 1 + length)]
                    if len(piece) == count - 1 + length:  # else it is of another row with the same id
                        fps.append(e["fp"])
                        docs.append(doc)
                        starts.append(start)
                        pieces.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(pieces, pa.binary())], schema=_CONTEXTS)

    return run


def refine(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Window starts (places in ``data``) and their bucket identifiers: equal ones are equal strings of ``length`` bytes.

    Singletons may be missing. Windows stay inside the strings that ``offsets`` bounds.
    """
    n = len(data)
    assert n < 2**31, "a bucket is bounded by HOT"
    ends = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))
    left = ends - np.arange(n, dtype=np.int32)  # bytes to the string's end
    step = min(8, length)
    alive = np.flatnonzero(left >= step).astype(np.int32)
    gram = B.octets(data)[alive] & np.uint64((1 << (8 * step)) - 1)
    _, back, counts = np.unique(gram, return_inverse=True, return_counts=True)
    del gram
    ids = np.full(n, -1, np.int32)
    ids[alive] = back
    alone = np.zeros(n, bool)
    alone[alive] = counts[back] == 1
    while step < length:
        shift = min(step, length - step)
        alive = alive[left[alive] >= step + shift]
        ok = alive[~alone[alive]]
        # a suffix whose bucket is alone stays alone; one whose later offset is alone is found alone here
        pair = ids[ok] * np.int64(n + 1) + ids[ok + shift]
        _, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
        del pair
        fresh = np.full(n, -1, np.int32)
        # identifiers of suffixes that are alone stay distinct from all others
        lonely = alive[alone[alive]]
        fresh[ok] = back
        fresh[lonely] = len(counts) + np.arange(len(lonely))
        alone[ok] = counts[back] == 1
        ids, step = fresh, step + shift
    alive = alive[~alone[alive]].astype(np.int64)
    return alive, ids[alive]


def _window_spans(doc: np.ndarray, place: np.ndarray, row: np.ndarray, names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows that aren't the first of their name; ``row`` keeps runs inside a context."""
    order = np.lexsort((place, doc, names))
    at = group_starts(names[order])
    head = order[np.repeat(at[:-1], np.diff(at))]
    later = order[(doc[order] != doc[head]) | (place[order] != place[head])]
    later = later[np.lexsort((place[later], row[later]))]
    d, p, r = doc[later], place[later], row[later]
    new = np.ones(len(later), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.append(np.flatnonzero(new), len(later))
    return d[at[:-1]], p[at[:-1]], p[at[1:] - 1] + length


def _refined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["fp"]):
            doc, start = rows["doc"].to_numpy(), rows["start"].to_numpy()
            data, offsets = B.view(rows["bytes"].combine_chunks().cast(pa.large_binary()))
            place, names = refine(data, offsets, length)
            row = np.searchsorted(offsets, place, side="right") - 1
            spans = _window_spans(doc[row], start[row] + place - offsets[row], row, names, length)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in spans], schema=_SPANS)

    return run


_NAMES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("start", pa.int64())])


def _named(length: int):
    """Windows of contexts with 128 bits of hash each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            data, offsets = B.view(got.column("bytes").cast(pa.large_binary()))
            doc, start = got.column("doc").to_numpy(), got.column("start").to_numpy()
            counts = np.maximum(np.diff(offsets) - length + 1, 0)
            row = np.repeat(np.arange(len(doc)), counts)
            place = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            halves = [B.slices_hash(data, place, place + length, seed).view(np.int64) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*halves, doc[row], start[row] + place - offsets[row])], schema=_NAMES)

    return run


_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_out(characters: bool):
    """Rows of id, text, spans and carried columns, with what is left of the text, the maximal spans and the text's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            data, offsets = B.view(got.column("text"))
            texts, found = [], []
            for a, b, spans in zip(offsets[:-1], offsets[1:], got.column("spans").to_pylist(), strict=True):
                text, merged = data[a:b], []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    s = (s[0], min(s[1], len(text)))
                    if s[0] >= s[1]:
                        continue
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                if merged:
                    keep = np.ones(len(text), bool)
                    for s, e in merged:
                        keep[s:e] = False
                        if characters:  # what is left of a character that an edge cuts goes too
                            while s > 0 and (text[s] & 0xC0) == 0x80:
                                s -= 1
                                keep[s] = False
                            while e < len(text) and (text[e] & 0xC0) == 0x80:
                                keep[e] = False
                                e += 1
                    text = text[keep]
                texts.append(text.tobytes())
                found.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([got.column("id"), pa.array(texts, pa.binary()), pa.array(found, _PLACES), pa.array(np.diff(offsets)), *got.columns[3:]], names=["id", "text", "spans", "n_bytes", *got.schema.names[3:]])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``(doc, start, end)``: byte ranges that repeat an earlier string; they may overlap."""
    if not 2 <= length <= 65_536:
        raise ValueError(f"length must be 2 to 65,536, not {length}")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    gram = min(GRAM, max(1, length // 2))
    rows = texts.mapInArrow(_anchor_rows(length, gram), "fp long, ctx long, doc long, packed long")
    dealt = rows.repartition("fp").sortWithinPartitions("fp", "ctx", "doc", "packed")
    found = cut(fewer_files(dealt.mapInArrow(_repeats(length), "edge boolean, fp long, doc long, packed long")), "repeats")

    start, count = F.shiftright("packed", _START), F.shiftright("packed", 1).bitwiseAND(F.lit(_COUNT))
    whole = found.where("NOT edge").select("doc", start.alias("start"), (start + count - 1 + length).alias("end"))

    edges = found.where("edge").groupBy("doc").agg(F.collect_list(F.struct("fp", "packed")).alias("edges"))
    contexts = texts.join(edges, texts.id == edges.doc).select("id", "text", "edges").mapInArrow(_contexts(length), "fp long, doc long, start long, bytes binary")
    contexts = cut(fewer_files(contexts), "contexts")
    large = contexts.groupBy("fp").count().where(F.col("count") > hot).select("fp")
    usual = contexts.join(large, "fp", "left_anti").repartition("fp").sortWithinPartitions("fp", "doc", "start")
    refined = usual.select("fp", "doc", "start", "bytes").mapInArrow(_refined(length), "doc long, start long, end long")

    named = contexts.join(large, "fp", "left_semi").mapInArrow(_named(length), "h1 long, h2 long, doc long, start long")
    first = named.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = named.join(first, ["h1", "h2"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(refined).unionByName(later)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, hot: int = HOT, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, ``kept`` (remaining bytes), ``spans`` (maximal removed byte ranges), ``n_bytes``, ``n_removed`` and the columns to ``carry``.

    With ``characters``, ``kept`` also leaves out what remains of characters of
    which a byte is removed, so it is UTF-8; spans and counts stay as they are.
    """
    spans = repeated_spans(docs, id_col, text_col, length=length, hot=hot)
    per_doc = spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carried)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[2:])
    joined = texts.join(per_doc, texts.id == per_doc.doc, "left").select("id", "text", "spans", *texts.columns[2:])
    out = fewer_files(joined).mapInArrow(_cut_out(characters), f"id long, text binary, spans array<struct<start:long,end:long>>, n_bytes long{kinds}")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s.end - s.start)
    return out.select(F.col("id").alias(id_col), F.col("text").alias("kept"), "spans", "n_bytes", removed.alias("n_removed"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))

"""Packing token sequences by the sum-of-squares rule.

A document's tokens are cut into pieces of at most ``capacity``; pieces go into
sequences of at most that many tokens. For each piece, longest first, the rule
looks at N(g), the number of open sequences with g free places, and takes the
place (or a new sequence) after which the sum of N(g)**2 is smallest; ties go to
the fullest sequence. It uses 2 * capacity numbers however many pieces there
are.

Scale. Written pieces are numbered and dealt out by their number, in turn, to
groups of at most ``GROUP`` rows, however many of them are equal; each group is
packed by one task on its own, and the number of groups grows with the input.
Further rounds pack the sequences that stayed open, as they are, in groups drawn
from many of the round before, until one group holds them all or a round saves
less than one sequence in a hundred. Only sequences, not pieces, are dealt again.

Tokens. The tokenizer is asked once per worker for each different word (words
end at white space, which the vocabulary drops); ids come from its cache.

Nulls, ties, repeats: a null or empty text has only its end token. Rows come
back piece by piece whatever their id (null, repeated). Ties are broken by
length, id and piece. Empty tables give empty results. Extra columns are ignored.
A very long text is tokenised whole in one task and leaves it in pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from tessera.llm import _bytes as B
from tessera.llm._cache import SliceCache
from tessera.llm._tables import small_batches
from tessera.scratch import cut, fewer_files

CAPACITY = 2048
END = 0
GROUP = 40_000
#: The number of a round is in three bits of a sequence's.
ROUNDS = 7
#: Words a worker remembers.
ENTRIES = 800_000


@cache
def _cached(path: str | None) -> SliceCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:  # the public vocabulary, found on the machine that asks
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]

    return SliceCache(encode, ENTRIES)


_PART = np.zeros(256, bool)
_PART[[ord(","), ord(".")]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def word_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slices that can be tokenised apart: words, and a comma or stop at a word's end by itself."""
    starts, ends, first = B.words(data, offsets)
    part = (ends - starts >= 2) & _PART[data[ends - 1]] & _ASCII_LETTER[data[np.maximum(ends - 2, 0)]] if len(ends) else np.zeros(0, bool)
    many = 1 + part.astype(np.int64)
    place = np.repeat(np.arange(len(starts)), many)
    tail = np.zeros(len(place), bool)
    tail[np.cumsum(many)[part] - 1] = True
    s = np.where(tail, ends[place] - 1, starts[place])
    e = np.where(~tail & part[place], ends[place] - 1, ends[place])
    return s, e, np.concatenate([[0], np.cumsum(many)])[first]


_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def _tokenize(path: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _cached(path)
        for got in batches:
            data, offsets = B.view(got.column("text"))
            if not (data == ord("<")).any():  # control strings are only such in the case written
                data = B.LOWER[data]
            starts, ends, first = word_slices(data, offsets)
            ids, n = tokens(data, B.slices_hash(data, starts, ends), starts, ends)
            at = np.concatenate([[0], np.cumsum(n)])[first]
            out: list[list] = [[] for _ in range(5)]
            for doc, a, b in zip(got.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                for p, s in enumerate(range(0, len(own), capacity)):
                    piece = own[s : s + capacity]
                    for column, x in zip(out, (doc, p, s, len(piece), piece.tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by free places; none are kept at 0 or capacity
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        rest = capacity - s
        fresh = 2 * count[rest] + 1 if rest else 0
        gap = capacity
        if s < capacity:
            own = count[s:capacity]
            change = 2 * (count[: capacity - s] - own) + 2
            change[0] = 1 - 2 * own[0]  # filled: nothing stays open
            change[own == 0] = 1 << 60
            best = int(change.argmin())
            if change[best] <= fresh:
                gap = s + best
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def _pack(capacity: int, schema: pa.Schema, round_: int):
    """Packs all rows of a group (``part`` names it): ``length`` each, the longest first."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((k, "ascending") for k in ("id", "piece", "start", "sequence_id") if k in rows.column_names)])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        base = (round_ << 60) + (rows["part"][0].as_py() << 32)
        used = np.bincount(bins, rows["length"].to_numpy()).astype(np.int64)[bins]
        for name, x in (("bin", base + bins), ("at", offsets), ("used", used)):
            rows = rows.append_column(name, pa.array(x))
        return rows.select(schema.names).cast(schema)

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(id, piece, start, length, ids)``: pieces of at most ``capacity`` tokens (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_tokenize(tokenizer, capacity, end), "id long, piece int, start long, length long, ids binary")


def _grouped(rows: DataFrame, part: Column, groups: int) -> GroupedData:
    """Groups named by ``part``, about one for each of ``groups`` tasks."""
    return rows.withColumn("part", part.cast("long")).repartition(groups, "part").groupBy("part")


def in_turn(number: Column, groups: int) -> Column:
    """Groups that differ by at most a row for each partition the numbers (of ``monotonically_increasing_id``) come from."""
    within, partition = number.bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(number, 33)
    return F.pmod(within + partition, F.lit(groups))


def _groups(rows: int, group: int, spare: int = 0) -> int:
    """How many groups of at most ``group`` rows there are, if each may get ``spare`` more than its share."""
    return max(1, -(-rows // (group - spare if group > 2 * spare else group)))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (id, piece, start, length and a checksum ``crc``) with ``sequence_id`` and ``offset``."""
    fields = "id long, piece int, start long, length long, crc long"
    # narrow rows, written in few files however many tasks tokenise; their numbers are written with them
    files = 4 * max(pieces.sparkSession.sparkContext.defaultParallelism, 2)
    pieces = cut(pieces.select("id", "piece", "start", "length", "crc").repartition(files).withColumn("n", F.monotonically_increasing_id()), "pieces")
    groups = _groups(pieces.count(), group, files)
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()), ("used", pa.int64())])
    first = cut(fewer_files(_grouped(pieces, in_turn(F.col("n"), groups), groups).applyInArrow(_pack(capacity, schema, 0), f"{fields}, bin long, at long, used long")), "packed")
    # sequences that stayed open are items of the next round, as they are
    level = first.where(F.col("used") < capacity).where("at = 0").select(F.col("bin").alias("sequence_id"), F.col("used").alias("length"))
    merged_schema = pa.schema([("sequence_id", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()), ("used", pa.int64())])
    moved, number, groups = None, 1, -(-groups // 16)
    while True:
        dealt = _grouped(level, F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)), groups)
        merged = cut(fewer_files(dealt.applyInArrow(_pack(capacity, merged_schema, number), "sequence_id long, bin long, at long, used long")), "merged")
        step = merged.select(F.col("sequence_id").alias("now"), F.col("bin").alias("new"), F.col("at").alias("by"))
        if moved is None:
            moved = step.select(F.col("now").alias("bin"), F.col("new").alias("new_bin"), F.col("by").alias("shift"))
        else:
            moved = moved.join(step, F.col("new_bin") == F.col("now"), "left").select("bin", F.coalesce("new", "new_bin").alias("new_bin"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
        made = merged.agg(F.count("*").alias("before"), F.count_if(F.col("at") == 0).alias("after")).first()
        if groups == 1 or made.after * 100 > made.before * 99 or number == ROUNDS:
            break
        level = merged.where(F.col("used") < capacity).where("at = 0").select(F.col("bin").alias("sequence_id"), F.col("used").alias("length"))
        number, groups = number + 1, _groups(level.count(), group)
    out = fewer_files(first.join(moved, "bin", "left"))
    return out.select("id", "piece", "start", "length", "crc", F.coalesce("new_bin", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))

"""Importance resampling: documents drawn in proportion to how well they fit a target's words.

Features of a text are its runs of one to three words, hashed into ``BUCKETS``.
A bucket's gain is the logarithm of its share in the target over its share in
the corpus (each count plus one); a document's weight is the sum of the gains
of its features, read from one array. A weight plus Gumbel noise, drawn from the
document's id alone, is its score; the best scores are a sample without
replacement.

Counting. A task sums its documents into one array and emits its non-zero
buckets, so the shuffle carries at most ``BUCKETS`` rows a task.

Selection. The cut at exactly the k-th row is found by radix selection over the
key (score falling, id rising, a number of the row that its first table keeps):
from the leading digit of 16 bits on, Spark counts the rows that share the digits
found so far by their next digit, and the driver picks the digit in which the
k-th row lies. It sees 65,536 counts at most, and stops when a digit ends at the
k-th row. Only the rows up to the cut are then sorted, by range, and ranked by
the sizes of the ranges before.

Nulls, ties, repeats: a null, empty or wordless text has no features and weight
0. A row without an id has a weight, but no score (null): it isn't counted and
not drawn. Equal scores go by id; rows that share both by their number, so each
drawn row has a rank of its own. An empty table gives an empty result, an empty
target the same gains from a target of no features. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm import _bytes as B
from tessera.llm._tables import small_batches
from tessera.scratch import cut

BUCKETS = 10_000
#: Words of the longest features.
RUN = 3
#: Words a document needs to be drawn.
LEAST_WORDS = 20
SEED = 42
DIGIT = 16

#: What ends a word, once A-Z are lower-cased: every ASCII character but digits and letters.
_APART = np.zeros(256, bool)
_APART[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@cache
def _byte_table() -> np.ndarray:
    """The checksum's register after each byte (polynomial EDB88320, reflected)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


@cache
def _shift_tables() -> np.ndarray:
    """(bits, 4, 256): what 2**bit zero bytes make of a register, by its four bytes."""
    table, places = _byte_table(), np.arange(256, dtype=np.uint32)
    one = np.stack([table, places, places << np.uint32(8), places << np.uint32(16)])
    out = [one]
    for _ in range(39):
        last = out[-1]
        out.append(np.stack([_through(last, last[i]) for i in range(4)]))
    return np.stack(out)


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 0xFF] ^ tables[1][(x >> 8) & 0xFF] ^ tables[2][(x >> 16) & 0xFF] ^ tables[3][x >> 24]


def shifted(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Registers after ``count`` zero bytes each."""
    out, tables = crc.copy(), _shift_tables()
    for bit in range(int(count.max(initial=0)).bit_length()):
        at = np.flatnonzero(count >> bit & 1)
        out[at] = _through(tables[bit], out[at])
    return out


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each slice: byte by byte through all slices at once, long ones by themselves."""
    size, table = ends - starts, _byte_table()
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(size <= B.LONG)
    for step in range(int(size[at].max(initial=0))):
        at = at[size[at] > step]
        crc[at] = table[(crc[at] ^ data[starts[at] + step]) & 0xFF] ^ (crc[at] >> 8)
    crc = ~crc
    for i in np.flatnonzero(size > B.LONG).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]])
    return crc


#: Bytes of text looked at together.
SPAN = 1 << 20


def _parts(low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SPAN`` bytes: whole texts, and parts of long ones that end between words."""
    last = 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a - last >= SPAN:
            yield last, a
            last = a
        while b - last > 2 * SPAN:
            at, apart = max(last, a) + SPAN, np.zeros(0, np.int64)
            while at < b and not len(apart):
                apart = np.flatnonzero(_APART[low[at : min(at + 65_536, b)]])
                at += int(apart[0]) if len(apart) else 65_536
            if at >= b:
                break
            yield last, at
            last = at
    yield last, len(low)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch the buckets of the features that end in it, the document of each, and the document of each word.

    The checksum of words joined by a space follows from those of its parts: the
    first part's, shifted by the length of the rest, xor the rest's.
    """
    low, whole = B.LOWER[data], set(offsets.tolist())
    lead: list[int] = []  # where the last words before a stretch begin, in the same document
    for a, b in _parts(low, offsets):
        begin = lead[0] if lead else a
        edges = np.array([begin, *offsets[(offsets > a) & (offsets < b)], b])
        starts, ends, first = B.words(low[begin:b], edges - begin, _APART)
        doc = np.repeat(np.arange(len(edges) - 1), np.diff(first))
        size, one = ends - starts, checksums(low[begin:b], starts, ends)
        spaced = shifted(np.full(len(one), zlib.crc32(b" "), np.uint32), size) ^ one  # of a space and the word
        run, last = one, np.arange(len(one))
        found, owners = [run[len(lead) :] % BUCKETS], [doc[len(lead) :]]
        for _ in range(RUN - 1):
            longer = last + 1 < first[doc[last] + 1]  # the next word is of the same document
            last = last[longer] + 1
            run = shifted(run[longer], size[last] + 1) ^ spaced[last]
            new = last >= len(lead)
            found.append(run[new] % BUCKETS)
            owners.append(doc[last[new]])
        base = int(np.searchsorted(offsets, a, side="right")) - 1
        yield np.concatenate(found), base + np.concatenate(owners), base + doc[len(lead) :]
        lead = [] if b in whole else (starts[first[-2] :][-(RUN - 1) :] + begin).tolist()


def _texts(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    named = [] if id_col is None else [F.col(id_col).cast("long").alias("id")]
    return docs.select(*named, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all documents fall into each bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for got in batches:
            for bucket, _, _ in features(*B.view(got.column("text"))):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "count"])

    summed = _texts(docs, None, text_col).mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, count in summed.collect():  # at most BUCKETS rows
        out[bucket] = count
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of target share over corpus share."""
    s, t = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            data, offsets = B.view(got.column("text"))
            rows = len(offsets) - 1
            n_words, n_features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for bucket, owner, word_owner in features(data, offsets):
                n_words += np.bincount(word_owner, minlength=rows)
                n_features += np.bincount(owner, minlength=rows)
                weight += np.bincount(owner, gain[bucket], rows).astype(np.int64)  # sums far below 2**53 are exact
            yield pa.RecordBatch.from_arrays([got.column("id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of every document."""
    gain = gains(counts(docs, text_col), counts(target, text_col))
    weighed = _texts(docs, id_col, text_col).mapInArrow(_weigh(gain), "id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _digits(key: Column, low: int, high: int) -> list[Column]:
    """Digits of a column whose values lie between two bounds, the leading one first; none if the bounds are equal."""
    size = 4
    if high - low < 1 << 62:
        key, size = key - F.lit(low), -(-(high - low).bit_length() // DIGIT)
    # the leading digit of all 64 bits keeps its sign, so digits compare as the numbers do
    return [F.shiftright(key, DIGIT * i) if i + 1 == size else F.shiftright(key, DIGIT * i).bitwiseAND(F.lit((1 << DIGIT) - 1)) for i in reversed(range(size))]


def smallest(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A condition that holds for exactly the first ``k`` of ``rows`` by ``keys``, whole numbers that tell all rows apart."""
    if k <= 0:
        return F.lit(False)
    ends = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in keys for f in (F.min, F.max))).first()
    digits = [d for c in keys if ends[f"min_{c}"] is not None for d in _digits(F.col(c), ends[f"min_{c}"], ends[f"max_{c}"])]
    below, same, left = F.lit(False), F.lit(True), k
    for digit in digits:
        found = rows.where(same).groupBy(digit.alias("digit")).count().orderBy("digit").collect()  # at most 65,536 rows
        for row in found:
            if left <= row["count"]:
                break
            left -= row["count"]
        below, same = below | (same & (digit < row.digit)), same & (digit == row.digit)
        if left == row["count"]:
            break
    return below | same


def ranked(rows: DataFrame, order: list[str], label: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... by ``order``: sorted by range, numbered in each range, plus the ranges before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    # numbers within a range rise with its rows' order, and the table fixes the ranges
    placed = cut(placed.withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")  # one row a range
    return placed.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("nth") + 1).drop("range", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, share: tuple[int, int] = (5, 100), least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every document; ``rank`` is null where it isn't drawn."""
    if not 0 <= share[0] <= share[1]:
        raise ValueError("share must lie between 0 and 1")
    table = scored(docs, target, id_col, text_col, seed=seed).withColumn("row", F.monotonically_increasing_id())
    table = cut(table, "scored").withColumn("falling", -F.col("score"))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n = table.where(able).count()
    drawn = able & smallest(table.where(able), ["falling", "id", "row"], n * share[0] // share[1])
    drawn = F.coalesce(drawn, F.lit(False))
    out = ["id", "n_features", "weight", "score", "rank"]
    chosen = ranked(table.where(drawn), ["falling", "id", "row"])
    rest = table.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return rest.select(*out).unionByName(chosen.select(*out))

"""Near-duplicate documents by b-bit MinHash.

Every document becomes the set of its distinct k-word shingles (64-bit hashes).
``LANES`` permutations give minima; bands of full minima make bucket keys, and
of each minimum only ``BITS`` low bits are kept, packed into a signature.
Within a bucket the similarity of two documents is estimated from the number of
equal lanes, corrected for lanes that agree by chance:

    J = (P - 2**-b) / (1 - 2**-b),   P = equal lanes / lanes

Pairs whose estimate comes within ``MARGIN`` standard deviations of the
threshold join documents into families; inside a family links are decided on the
full sets, by integers, so estimates and buckets never make a link.

Scale. Copies with the same set are one representative before anything is
paired (a partially aggregated minimum). Buckets above ``BLOCK`` members are
dealt out as pairs of blocks, so no task holds an unbounded group, and a task
gives out a forest of close pairs instead of all pairs. In a family of more than
two ``FAMILY_BLOCK`` members the forest's pairs are confirmed first (a hub's
pairs are salted). Then buckets are looked through again for close pairs between
parts that this left apart; only these meet on full sets, in groups of two blocks
of the family, to which no member goes that has no such pair there. So near copies
of one text, and chains of texts that fall apart, cost in proportion to their
close pairs. Links, families and components stay distributed tables.

Recall. The rows of a band are chosen so that a pair exactly at the threshold
misses all bands with a probability below 1e-6.

Nulls, ties, repeats: a null or empty text (or one without words) has the empty
set and is linked with nothing. A row without an id is kept as its own
component (null). Rows that share an id are one node; each row comes back.
Empty tables give empty results. Extra columns are ignored. A very long text is
one row, its set one array of eight bytes a shingle. Shingles are told apart by
64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.graph import connected_components
from tessera.llm import _bytes as B
from tessera.llm._tables import group_starts, lists, runs, small_batches
from tessera.scratch import cut, fewer_files

LANES = 128
BITS = 4
MARGIN = 5.0
BLOCK = 512
FAMILY_BLOCK = 128
_SIGNATURE = LANES * BITS // 64

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(1, 2**32, LANES, dtype=np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 2**32, LANES, dtype=np.uint32)


def band_rows(threshold: float) -> int:
    """The most rows a band may have with a miss below 1e-6 at the threshold."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (LANES // r) < 1e-6)


def signature(hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima (uint64) and the bucket key of each band of one non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (x[None, i : i + 4096] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=least)
    wide = B.mix(least.astype(np.uint64) + np.arange(LANES, dtype=np.uint64) * np.uint64(1 << 32))
    nibbles = (wide & np.uint64((1 << BITS) - 1)).reshape(_SIGNATURE, -1)
    packed = np.zeros(_SIGNATURE, np.uint64)
    for i in range(nibbles.shape[1]):
        packed |= nibbles[:, i] << np.uint64(i * BITS)
    bands = LANES // rows
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = B.mix(keys * np.uint64(0x9FB21C651E98DF25) + wide[: bands * rows].reshape(bands, rows)[:, i])
    return packed, keys


def equal_lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal lanes of packed signatures (last axis), by folding differences and counting bits."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return LANES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def estimate(lanes: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from equal lanes."""
    chance = 2.0**-BITS
    return (np.asarray(lanes) / LANES - chance) / (1 - chance)


def estimate_column(a: str, b: str) -> Column:
    """The same estimate for two ``array<bigint>`` signature columns, as a SQL expression."""
    folded = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    folded = F.transform(folded, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
    folded = F.transform(folded, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    unequal = F.aggregate(F.transform(folded, F.bit_count), F.lit(0), lambda acc, x: acc + x)
    return (1 - unequal / LANES - 2.0**-BITS) / (1 - 2.0**-BITS)


def least_lanes(threshold: float) -> int:
    """Lanes that a pair at the threshold still has, but for MARGIN standard deviations."""
    p = threshold * (1 - 2.0**-BITS) + 2.0**-BITS
    return int(np.floor(LANES * p - MARGIN * np.sqrt(LANES * p * (1 - p))))


_SIGNED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("signature", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_STARS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sets(got: pa.RecordBatch, k: int) -> list[np.ndarray]:
    data, offsets = B.view(got.column("text"))
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offsets)
    hashes = B.slices_hash(data, starts, ends)
    return [B.shingles(hashes[a:b], k) for a, b in zip(first[:-1], first[1:], strict=True)]


def _sign(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0x5851F42D4C957F2D)
        for got in batches:
            sets = _sets(got, k)
            n = np.array([len(s) for s in sets], np.int64)
            k1, k2 = (np.array([int(B.mix(s ^ x).sum()) for s in sets], np.uint64) if len(sets) else np.zeros(0, np.uint64) for x in (np.uint64(0), salt))
            signed = [signature(s, rows) if len(s) else (np.zeros(0, np.uint64),) * 2 for s in sets]
            lanes, bands = (lists(np.concatenate([x[i] for x in signed]).view(np.int64) if signed else np.zeros(0, np.int64), np.array([len(x[i]) for x in signed], np.int64), pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([got.column("id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lanes, bands], schema=_SIGNED)

    return run


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            sets = _sets(got, k)
            column = lists(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64), np.array([len(s) for s in sets], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([got.column("id"), column], schema=_SETS)

    return run


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between rows a and b: each row that isn't its component's first, and that first row's id."""
    away, label = _labels(len(ids), a, b)
    return ids[away], ids[label[away]]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that aren't their component's first under links a to b, and every row's component (its first row)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            break
    return np.flatnonzero(label != np.arange(n)), label


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows (a < b, below n) enough to connect what all of them connect: each row's first partner, then what is missing."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    kept_a, kept_b = a[first], b[first]
    _, label = _labels(n, kept_a, kept_b)
    apart = label[a] != label[b]
    parent = dict[int, int]()

    def find(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    more = []
    for k in np.flatnonzero(apart).tolist():
        x, y = find(int(label[a[k]])), find(int(label[b[k]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            more.append(k)
    return np.concatenate([kept_a, a[more]]), np.concatenate([kept_b, b[more]])


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside groups of the given sizes, the groups of one size at once."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(m), 1)
        at = starts[sizes == m]
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _close(lanes: int):
    """A forest of the documents that come close inside each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "i", "j"]):
            key, i, j, ids = (rows[c].to_numpy() for c in ("key", "i", "j", "id"))
            column = rows["signature"].combine_chunks()
            packed = column.flatten().to_numpy().view(np.uint64).reshape(-1, _SIGNATURE)
            at = group_starts(key, i, j)
            sizes, starts = np.diff(at), at[:-1]
            small = sizes <= 32
            a, b = _pairs(sizes[small], starts[small])
            keep = equal_lanes(packed[a], packed[b]) >= lanes
            found = [(a[keep], b[keep])]
            for s, m in zip(starts[~small], sizes[~small], strict=True):
                for r in range(m - 1):
                    near = np.flatnonzero(equal_lanes(packed[s + r], packed[s + r + 1 : s + m]) >= lanes)
                    if len(near):
                        found.append((np.full(len(near), s + r), s + r + 1 + near))
            u, v = _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[v]), pa.array(ids[u])], schema=_STARS)

    return run


_MET = pa.schema([("family", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("id", pa.int64())])


def _across(lanes: int):
    """Where close pairs of different parts meet: (family, i, j, id), each once a batch.

    Blocks of a family go by ``own``; a pair meets where its two blocks do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "i", "j"]):
            key, i, j, ids, part, own, family = (rows[c].to_numpy() for c in ("key", "i", "j", "id", "part", "own", "family"))
            packed = rows["signature"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _SIGNATURE)
            at = group_starts(key, i, j)
            found = [np.zeros((0, 4), np.int64)]
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                names, many = np.unique(part[s:e], return_counts=True)
                usual = names[many.argmax()]  # of two parts one is another, so only rows of others look for partners
                for r in (s + np.flatnonzero(part[s:e] != usual)).tolist():
                    near = s + np.flatnonzero(part[s:e] != part[r])
                    near = near[(near > r) | (part[near] == usual)]
                    near = near[equal_lanes(packed[r], packed[near]) >= lanes]
                    if len(near):
                        low, high = np.minimum(own[near], own[r]), np.maximum(own[near], own[r])
                        pair = np.stack([np.full(len(near), family[r]), low, high], 1)
                        found.append(np.concatenate([np.column_stack([pair, ids[near]]), np.unique(np.column_stack([pair, np.full(len(near), ids[r])]), axis=0)]))
            met = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(met[:, k]).cast(f.type) for k, f in enumerate(_MET)], schema=_MET)

    return run


def _shared(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of m sets: an m x m matrix."""
    m = len(lengths)
    owner = np.repeat(np.arange(m), lengths)
    order = np.argsort(values, kind="stable")
    at = group_starts(values[order])
    often = np.repeat(np.diff(at) > 1, np.diff(at))
    column = np.cumsum(np.diff(at) > 1) - 1
    column, row = np.repeat(column, np.diff(at))[often], owner[order][often]
    out = np.zeros((m, m), np.float64)
    wide = int(column[-1]) + 1 if len(column) else 0
    step = max(64, (1 << 22) // max(m, 1))
    for c in range(0, wide, step):
        a, b = np.searchsorted(column, [c, c + step])
        has = np.zeros((m, min(step, wide - c)), np.float32)
        has[row[a:b], column[a:b] - c] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _confirm(num: int, den: int):
    """Stars of the documents linked on full sets inside each family or pair of blocks; links have an open document at one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["family", "i", "j"]):
            family, i, j, ids, open_ = (rows[c].to_numpy() for c in ("family", "i", "j", "id", "open"))
            column = rows["shingles"].combine_chunks()
            values = column.flatten().to_numpy()
            lengths = np.diff(column.offsets.to_numpy())
            begin = np.concatenate([[0], np.cumsum(lengths)])
            at = group_starts(family, i, j)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s < 2:
                    continue
                n = lengths[s:e].astype(np.int64)
                both = _shared(values[begin[s] : begin[e]], n)
                x, y = np.triu_indices(e - s, 1)
                common = both[x, y]
                linked = (open_[s:e][x] | open_[s:e][y]) & (den * common >= num * (n[x] + n[y] - common)) & (n[x] > 0) & (n[y] > 0)
                u, v = _stars(ids[s:e], x[linked], y[linked])
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=_STARS)

    return run


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each key with the pairs of blocks (i, j) they belong to; keys of one row are left out.

    A key of up to BLOCK rows is one block. A larger one has as many blocks as
    it needs, and every pair of them is a group of its own.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    rows = rows.join(sizes, key).withColumn("_own", own)
    partner = F.explode(F.when(F.col("_blocks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("_other", partner)
    one = F.col("_blocks") <= 2  # two blocks make one pair: the whole group
    same = (F.col("_own") == F.col("_other")) & ~one  # a block alone is inside each of its pairs
    return rows.where(~same).withColumn("i", F.when(one, 0).otherwise(F.least("_own", "_other"))).withColumn("j", F.when(one, 0).otherwise(F.greatest("_own", "_other"))).drop("_n", "_blocks", "_own", "_other")


def _large(sets: DataFrame, members: DataFrame, close: DataFrame, signed: DataFrame, lanes: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For large families: links among the close pairs, and the groups in which close pairs of parts that are still apart meet.

    ``sets`` is (id, shingles), ``members`` (family, id, n), ``close`` pairs (u, v),
    ``signed`` (id, signature, bands).
    """
    pairs = close.join(members.select(F.col("id").alias("u")), "u")
    hubs = pairs.groupBy("v").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("salts"))
    left = pairs.join(hubs, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("x")), "u")
    right = hubs.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = right.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y"))
    linked = left.join(right, ["v", "salt"]).where(den * common >= num * (F.size("x") + F.size("y") - common))
    confirmed = cut(linked.select("u", "v").distinct(), "confirmed", compact=True)

    parts = connected_components(confirmed)
    named = members.join(parts, members.id == parts.node, "left").select("family", "id", "n", F.coalesce("component", "id").alias("part"))
    apart = named.groupBy("family").agg((F.min("part") != F.max("part")).alias("apart")).where("apart").select("family")
    named = named.join(apart, "family", "left_semi").withColumn("own", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FAMILY_BLOCK)).cast("int"))
    # only members of families that are still apart are opened into their buckets
    held = signed.join(named.select("id", "family", "part", "own"), "id").select("id", "signature", "family", "part", "own", F.explode("bands").alias("key"))
    buckets = _blocks(held, "key").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    met = buckets.select("key", "i", "j", "id", "part", "own", "family", "signature").mapInArrow(_across(lanes), "family long, i int, j int, id long").distinct()
    return confirmed, met.join(sets, "id").select("family", "i", "j", "id", F.lit(True).alias("open"), "shingles")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents are linked when their sets' Jaccard similarity is at least
    ``similarity`` (numerator, denominator).
    """
    spark = docs.sparkSession
    small_batches(spark)
    num, den = similarity
    ratio = float(Fraction(num, den))
    rows, lanes = band_rows(ratio), least_lanes(ratio)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_sign(shingle, rows), "id long, n_shingles long, k1 long, k2 long, signature array<long>, bands array<long>"), "signed")

    usable = signed.where("n_shingles > 0 AND id IS NOT NULL")
    reps = cut(usable.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "representatives", compact=True)

    members = reps.select(F.col("rep").alias("id"), "signature", F.explode("bands").alias("key"))
    buckets = _blocks(members, "key").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    close = buckets.select("key", "i", "j", "id", "signature").mapInArrow(_close(lanes), "u long, v long")
    close = cut(close.distinct(), "close", compact=True)
    families = cut(connected_components(close).select(F.col("node").alias("id"), F.col("component").alias("family")), "families", compact=True)
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    large = families.join(sizes.where(F.col("n") > 2 * FAMILY_BLOCK), "family")

    def sets(members: DataFrame) -> DataFrame:
        named = texts.join(members.select("id"), "id").select("id", "text")
        return named.mapInArrow(_shingle_rows(shingle), "id long, shingles array<long>")

    usual = families.join(sizes.where(F.col("n") <= 2 * FAMILY_BLOCK).select("family"), "family", "left_semi")
    dealt = sets(usual).join(usual, "id").select("family", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.lit(True).alias("open"), "shingles")
    confirmed = None
    if not large.isEmpty():
        held = cut(sets(large), "sets")
        confirmed, more = _large(held, large, close, reps.select(F.col("rep").alias("id"), "signature", "bands"), lanes, num, den)
        dealt = dealt.unionByName(more)
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id")
    links = dealt.mapInArrow(_confirm(num, den), "u long, v long")
    if confirmed is not None:
        links = links.unionByName(confirmed)
    components = connected_components(links)

    found = reps.join(components, reps.rep == components.node, "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = fewer_files(signed.select("id", "n_shingles", "k1", "k2").join(found, ["k1", "k2", "n_shingles"], "left"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

"""Texts of a megabyte and more, single words of that size, many secrets, and strings made to collide."""

import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, media, packing, secrets
from tessera.llm._cache import SliceCache
from tessera.llm.suffix_dedup import remove_repeats

from test_minhash_families import thue_morse
from test_operators import repeats, sha, tiktoken_encoding


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def long_texts():
    r = random.Random(8)
    words = ["".join(r.choice("abcdeéstu'") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    prose = " ".join(r.choice(words) for _ in range(700_000))
    return [prose[:5_000_000], "x" * 2_000_000, "a" + " " * 50_000 + "\n" * 7 + "b1 'tis", "".join(r.choice("abcdefgh") for _ in range(300_000))]


def test_bpe_long(spark):
    encoding, _ = tiktoken_encoding()
    texts = [t for n in (1024, 4096) for one, other in [thue_morse(n)] for t in (f"z {one} {other}", f"z {other} {one}")] + long_texts()
    got = byte_bpe.round_trip(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert bytes(r.decoded).decode() == texts[r.id]
        if len(texts[r.id]) != 2_000_000:  # the library takes too long for that word
            assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(texts[r.id])


def test_long_merge_is_merge(monkeypatch):
    _, ranks = tiktoken_encoding()
    r = random.Random(2)
    for _ in range(300):
        piece = "".join(r.choice("abcdeinrst é") for _ in range(r.randint(2, 150))).encode()
        want = byte_bpe.merge(piece, ranks)
        if len(want) > 1:
            assert byte_bpe._merge_long(piece, ranks) == want
    began = time.perf_counter()
    byte_bpe.merge(b"x" * 1_000_000, ranks)
    assert time.perf_counter() - began < 30


def test_stretches_begin_where_tokens_do(monkeypatch):
    encoding, _ = tiktoken_encoding()
    monkeypatch.setattr(byte_bpe, "SPAN", 40)
    r = random.Random(4)
    for _ in range(50):
        texts = ["".join(r.choice("ab'st  \n1.é日") for _ in range(r.randrange(400))).encode() for _ in range(5)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        cuts = set(byte_bpe.stretches(data, offsets))
        begins = {0, len(data)}
        for t, a in zip(texts, offsets):
            at = int(a)
            for i in encoding.encode_ordinary(t.decode()):
                begins.add(at)
                at += len(encoding.decode_single_token_bytes(i))
        assert cuts <= begins


def test_slices_of_one_hash_keep_their_ids():
    cache = SliceCache(lambda pieces: [[p[0], len(p)] for p in pieces])
    data = np.frombuffer(b"abcabdabcxabc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 10]), np.array([3, 6, 9, 10, 13])
    for _ in range(2):
        ids, n = cache(data, np.zeros(5, np.uint64), starts, ends)
        assert n.tolist() == [2] * 5 and ids.tolist() == [97, 3, 97, 3, 97, 3, 120, 1, 97, 3]
    assert set(cache.place) == {b"abc", b"abd", b"x"}


def test_packing_tells_words_apart(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [t for n in (1024, 4096) for one, other in [thue_morse(n)] for t in (f"{one} z {other}", f"{other} z {one}")]
    got = {}
    for r in sorted(packing.tokenize(frame(spark, texts)).collect(), key=lambda r: (r.id, r.piece)):
        got.setdefault(r.id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


@pytest.mark.parametrize("hot", [8192, 1])
def test_suffix_strings_that_polynomials_confuse(spark, hot):
    one, other = thue_morse(1024)
    rows = list(enumerate([one, other, one[:500] + "|" + other[:400], other + one, "ab" * 700, one * 3]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), sha(bytes(r.kept))) for r in remove_repeats(frame(spark, [t for _, t in rows]), length=100, hot=hot).collect()}
    assert got == repeats(rows, 100)


def test_suffix_longer_windows(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = list(enumerate([text, "x" + text[500:1600] + "y", text[:999], "q" * 2500]))
    for length in (300, 1000):
        got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), sha(bytes(x.kept))) for x in remove_repeats(frame(spark, [t for _, t in rows]), length=length).collect()}
        assert got == repeats(rows, length)
    with pytest.raises(ValueError, match="length"):
        remove_repeats(frame(spark, ["a"]), length=70_000)


def test_many_secrets():
    r = random.Random(1)
    one = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    text = " ".join(f"password={one(12)} {one(40)}" for _ in range(50_000))
    began = time.perf_counter()
    base, spans = secrets.all_spans(text)
    assert time.perf_counter() - began < 60
    assert len(base) == 50_000 and len(spans) > 90_000
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_entropy_leaves_base_spans_alone():
    r = random.Random(7)
    text = " ".join(r.choice(["token=Zq8vT3nLw0XyR5bKd7Pf", "Zq8vT3nLw0XyR5bKd7Pf==", "0f" * 13, "word", "AKIA" + "Q7" * 9 + "zT3nLw0XyR5bKd7Pfm"]) for _ in range(400))
    base, spans = secrets.all_spans(text)
    want = []
    for m in secrets.CANDIDATE.finditer(text):
        if secrets.ALLOWED.fullmatch(m[0]) or secrets.ALLOWED_BEFORE.search(text, max(0, m.start() - 16), m.start()):
            continue
        kind = next((k for k, p in secrets._CLASSES if p.fullmatch(m[0])), "mixed")
        for a, b in secrets.entropy_runs(m[0], secrets.LIMITS[kind]):
            if not any(a + m.start() < e and s < b + m.start() for _, s, e in base):
                want.append(("entropy", a + m.start(), b + m.start()))
    assert [s for s in spans if s[0] == "entropy"] == want and want


def test_media_long(spark):
    text = "some words é " * 300_000
    got = media.read_back(media.store_texts(frame(spark, [text, None]))).orderBy("id").collect()
    assert got[0].n_bytes == len(text.encode()) and got[1].n_bytes == 0 and got[0].forms_agree and got[1].forms_agree


def test_strips_make_no_difference(monkeypatch):
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (97, 31, 3), dtype=np.uint8)
    want = media.resize(image, 16, 16)
    monkeypatch.setattr(media, "STRIP", 5)
    assert (media.resize(image, 16, 16) == want).all()
    # every cell is the mean of the area under it
    for height, width in ((8, 9), (16, 16), (97, 31), (200, 40)):
        fine = image.repeat(height, 0).repeat(width, 1).astype(np.int64)
        plain = fine.reshape(height, 97, width, 31, 3).sum((1, 3)) / (97 * 31)
        assert np.abs(media.resize(image, height, width).astype(int) - np.floor(plain + 0.5)).max() <= 1
        assert (media.resize(image, height, width) == np.floor(plain + 0.5)).mean() > 0.99


def test_difference_hash_is_plain():
    r = np.random.default_rng(6)
    for _ in range(20):
        image = r.integers(0, 256, (8 * int(r.integers(1, 9)), 9 * int(r.integers(1, 9)), 3), dtype=np.uint8)
        h, w, _ = image.shape
        small = np.floor(image.reshape(8, h // 8, 9, w // 9, 3).mean((1, 3)) + 0.5).astype(int)
        tone = (small.sum(2) + 1) // 3
        bits = "".join("1" if tone[y, x + 1] > tone[y, x] else "0" for y in range(8) for x in range(8))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"


def plain_sum_of_squares(sizes, capacity):
    """The rule by trying every open bin."""
    bins, out = [], []

    def cost(free):
        count = {}
        for f in free:
            if 0 < f < capacity:
                count[f] = count.get(f, 0) + 1
        return sum(c * c for c in count.values())

    for s in sizes:
        best = None
        for b, used in enumerate(bins):
            if used + s <= capacity:
                free = [capacity - u - (s if i == b else 0) for i, u in enumerate(bins)]
                key = (cost(free), 0, capacity - used)
                best = min(best, (key, used)) if best else (key, used)
        fresh = (cost([capacity - u for u in bins] + [capacity - s]), 1, 0)
        if best and best[0] <= fresh:
            i = bins.index(best[1])
            bins[i] += s
        else:
            bins.append(s)
        out.append(best[1] if best and best[0] <= fresh else 0)
    return out, sorted(bins)


def test_sum_of_squares_is_the_rule():
    r = random.Random(11)
    for _ in range(60):
        capacity = r.choice([7, 12, 20])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 40))), reverse=True)
        bins, offsets = packing.sum_of_squares(np.array(sizes), capacity)
        want, levels = plain_sum_of_squares(sizes, capacity)
        assert offsets.tolist() == want
        assert sorted(np.bincount(bins, sizes).astype(int).tolist()) == levels


def test_spans_of_a_long_text_by_columns(spark):
    """A long text beside small ones comes back row for row."""
    df = frame(spark, ["token=abcdefgh " * 70_000, None, ""])
    rows = secrets.scan(df).select("doc_id", F.col("n_assign")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_assign) for r in rows] == [(0, 70_000), (1, 0), (2, 0)]


@pytest.mark.parametrize("raw", [
    b"P6 99999999999999999999 1 255\n" + b"x" * 30, b"P4 99999999999999999999 1\n" + b"x" * 30, b"P6 2147483647 2147483647 255\nabc", b"P5 3 3 0\nabcdefghi", b"P5 3 3 70000\nabcdefghi" * 3,
    b"P2 1 1 255\n99999999999999999999999", b"P2 1 1 255\n256", b"P2 1 1 9\n10", b"P2 1 1 9\n-1", b"P2 2 1 9\n1", b"P1 2 1\n7 0", b"P1 2 1\n0", b"P5 1 1 99999999999999\na", b"P5 2 2 100\n" + bytes([1, 2, 3, 101]), b"P5 0 3 255\n", b"P6", b"P3 #", b"P5 1 1", b"P7 1 1 255\na", b"P5 -1 1 255\na",
    struct.pack("<2sIHHI", b"BM", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2**31 - 1, 2**31 - 1, 1, 24, 0, 0, 0, 0, 0, 0), struct.pack("<2sIHHI", b"BM", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, -(2**31), 1, 32, 0, 0, 0, 0, 0, 0), struct.pack("<2sIHHI", b"BM", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 0, 1, 24, 0, 0, 0, 0, 0, 0) + b"abcd",
    struct.pack("<2sIHHI", b"BM", 62, 0, 0, 58) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 8, 0, 4, 0, 0, 2**32 - 1, 0) + b"\0" * 8, struct.pack("<2sIHHI", b"BM", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0) + struct.pack("<4I", 1, 2, 4, 0),
])
def test_damaged_images_are_null(raw):
    assert media.decode_image(raw) is None


def test_random_bytes_are_no_crash(spark):
    r = random.Random(12)
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    whole = [media.encode_netpbm(image), media.encode_bmp(image), b"P2 2 2 9\n1 2 3 9", b"P1 2 2\n1 0 0 1", b"P4 9 1\nab", b"P5 1 2 65535\nabcd"]
    assert all(media.decode_image(x) is not None for x in whole)
    cases = [bytes(r.randrange(256) if r.random() < 0.05 else b for b in r.choice(whole)) for _ in range(3000)]
    cases += [r.choice(whole)[: r.randrange(60)] for _ in range(500)] + [r.choice([b"BM", b"P%d" % r.randint(0, 9)]) + r.randbytes(r.randrange(80)) for _ in range(1500)]
    cases += [b"P%d %d %d %d\n" % (r.randint(1, 6), r.choice([0, 1, 2, 10**30, 2**31]), r.choice([1, 2, 2**40]), r.choice([0, 1, 255, 256, 65535, 65536])) + r.randbytes(20) for _ in range(1500)]
    out = media.describe(spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate([*whole, *cases, None])], "id long, media binary")).collect()
    assert len(out) == len(whole) + len(cases) + 1 and all(x.width for x in out if x.id < len(whole))
    assert all((x.width is None) == (x.tile is None) == (x.dhash is None) for x in out)


def test_equal_pieces_are_dealt_evenly(spark):
    """A hot id, or none: 200,000 equal rows meant for 8 groups, and no group has more than its bound."""
    files = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(200_000).select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(7).cast("long").alias("length"), F.lit(5).cast("long").alias("crc"))
    groups = packing._groups(200_000, 25_000, files)
    numbered = rows.repartition(files).withColumn("n", F.monotonically_increasing_id())
    sizes = [r["count"] for r in numbered.groupBy(packing.in_turn(F.col("n"), groups)).count().collect()]
    assert len(sizes) == groups == 9 and max(sizes) <= 25_000 and max(sizes) - min(sizes) <= files
    out = packing.pack(rows.limit(20_000), group=5_000)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("places"), F.count("*").alias("rows"))
    got = full.agg(F.sum("rows"), F.max("n"), F.count("*"), F.count_if("places <> rows")).first()
    assert (got[0], got[1], got[3]) == (20_000, 2044, 0) and got[2] <= 74  # 69 can't be undercut; each group may leave one open

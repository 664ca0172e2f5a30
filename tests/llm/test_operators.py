"""Each corpus operator against a plain version, with its odd cases."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat, licenses, media, merkle, packing, quality, secrets
from tessera.llm.minhash import band_rows, equal_lanes, estimate, near_duplicates, signature
from tessera.llm.suffix_dedup import remove_repeats


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_minhash(docs, rows, k, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle=k, similarity=(num, den)).collect()}
    assert got == components(rows, k, num, den)


def test_minhash_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr("tessera.llm.minhash.BLOCK", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == components(rows, 3, 85, 100)


def test_minhash_odd_rows(spark, empty):
    assert near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(False, 3, 3, True), (False, 7, 7, True), (False, 7, 7, True)]
    assert near_duplicates(df).where("doc_id IS NULL AND component_id IS NULL AND kept").count() == 1


def test_estimate_is_close():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 2000, dtype=np.uint64)
    other = np.concatenate([base[:1800], r.integers(0, 2**63, 200, dtype=np.uint64)])
    a, b = (signature(np.unique(x), band_rows(0.8))[0] for x in (base, other))
    assert abs(estimate(equal_lanes(a, b)) - 1800 / 2200) < 0.15


def repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,hot", [(100, 65536), (100, 1), (20, 65536), (9, 2)])
def test_suffix(docs, rows, length, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), sha(bytes(r.kept))) for r in remove_repeats(docs, length=length, hot=hot).collect()}
    assert got == repeats(rows, length)


def test_suffix_odd_rows(spark, empty):
    assert remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(None, "q" * 300), (1, "w" * 150), (1, "w" * 150)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(0, 0), (1, 149), (1, 149)]


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@pytest.mark.parametrize("stretch", [1 << 18, 7])
def test_bpe(docs, rows, empty, stretch):
    encoding, ranks = tiktoken_encoding()
    want = dict(rows)
    got = byte_bpe.encode(docs).collect()
    assert len(got) == len(rows) and byte_bpe.round_trip(empty).count() == 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == encoding.encode_ordinary(want[r.id] or ""), want[r.id][:80]
        ends = np.frombuffer(r.ends, "<u4").tolist()
        assert ends == np.cumsum([len(encoding.decode_single_token_bytes(i)) for i in ids]).tolist()
    for r in byte_bpe.round_trip(docs).collect():
        assert bytes(r.decoded).decode() == (want[r.id] or "")


def test_boundaries_across_stretches(monkeypatch):
    import random

    encoding, _ = tiktoken_encoding()
    r = random.Random(3)
    monkeypatch.setattr(byte_bpe, "STRETCH", 5)
    for _ in range(300):
        text = "".join(r.choice("ab'streldmv  \n\t1.é日") for _ in range(r.randrange(40)))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[:1] = True
        starts = [0]
        for i in encoding.encode_ordinary(text):
            starts.append(starts[-1] + len(encoding.decode_single_token_bytes(i)))
        found = np.flatnonzero(byte_bpe.boundaries(points, first)).tolist()
        at = [len(text[:f].encode()) for f in found]
        assert set(at) <= set(starts)  # tokens never cross a pre-token's start


def test_packing(docs, rows, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    pieces = packing.tokenize(docs)
    ids = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r.id, r.piece)):
        assert r.start == len(ids[r.id]) and r.length <= 2048
        ids[r.id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids == want
    for group in (40_000, 5):
        packed = packing.pack(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("crc")), group=group).collect()
        by = defaultdict(list)
        for r in packed:
            by[r.sequence_id].append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert sum(map(len, by.values())) == sum(-(-len(x) // 2048) for x in want.values())
    assert packing.pack(packing.tokenize(empty).select("id", "piece", "start", "length", F.crc32("ids").alias("crc"))).count() == 0


def test_sum_of_squares_fills():
    sizes = np.array([6, 6, 4, 4, 5, 5])
    bins, offsets = packing.sum_of_squares(sizes, 10)
    assert len(set(bins.tolist())) == 3 and offsets.max() == 6


def plain_base(text):
    out = []
    for kind, pattern in (("assign", secrets.ASSIGN.pattern), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)):
            if len(m[2]) >= 6 if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24):
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secrets(docs, rows, empty):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert secrets.scan(empty).count() == 0 and len(got) == len(rows)
    for i, t in rows:
        base = plain_base(t or "")
        assert got[i].base_sha256 == sha(base)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("entropy")] == [s for s in base.split(",") if s]
    odd = dict((t, i) for i, t in rows if t and t.startswith("key "))
    (text, i), = odd.items()
    assert got[i].spans == f"entropy:4:{4 + 20}"  # the key, not the UUID
    assert secrets.redacted(text, secrets.all_spans(text)[1]) == "key [secret] and uuid 123e4567-e89b-12d3-a456-426614174000"
    assert secrets.base_spans("password:token:abcdefgh") == [] and secrets.base_spans("to\u212aen=abcdef") == []  # a Kelvin sign is no k


def test_entropy_is_incremental():
    from math import log2

    text = "Zq8vT3nLw0XyR5bKd7PfaaaaaaaaaaaaaaaaaaaaaaaaaB1"
    wins = [text[i : i + 20] for i in range(len(text) - 19)]
    entropy = [-sum(w.count(c) / 20 * log2(w.count(c) / 20) for c in set(w)) for w in wins]
    covered = {j for i, e in enumerate(entropy) if e >= 3.9 for j in range(i, i + 20)}
    assert {j for a, b in secrets.entropy_runs(text, 3.9) for j in range(a, b)} == covered


def test_licenses(docs, rows, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert licenses.scan(empty).count() == 0
    for i, t in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(words) - len(p) + 1) if words[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_passage(spark):
    text = next(iter(licenses.PASSAGES)).replace("free of charge", "wholly free of charge")
    row = licenses.scan(spark.createDataFrame([(1, "before " + text + " after")], "doc_id long, text string")).first()
    assert row.labels == "mit-text" and row.score >= 0.6


def test_merkle(docs, rows, empty):
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    assert merkle.edited_fingerprints(empty).count() == 0
    text = {i: t or "" for i, t in rows}
    order = sorted(text)
    prints = {}
    for i, j in zip(order, order[1:] + order[:1]):
        k = len(text[i]) // 4
        assert (got[i].n_chars, got[i].edited) == (len(text[i]), text[i][: len(text[i]) - k] + text[j][:k])
        assert prints.setdefault(text[i], got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert len(set(prints.values())) == len(prints)


def test_merkle_locates_edits(spark):
    a, b = "one.\ntwo.\n\nthree.\nfour.", "one.\ntwo.\n\nthree.\nfive."
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differing(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d"))
    assert [tuple(x) for x in df.first().d] == [(1, 1)]


def test_chat(spark):
    said = "</s>[INST] ok [/INST] <|im_end|>\n <\\|im_end|> [\\\\INST]"
    turns = [(1, 0, "system", "be kind"), *((1, i, ("assistant", "user")[i % 2], f"turn {i} " + "word " * (i * 7)) for i in range(1, 40)), (2, 0, "user", said), (2, 1, "assistant", said), (3, 0, None, None), (4, 0, "a%0A\nb", "x"), (4, 0, "a%0A\nb", "x"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in sorted(chat.read(chat.windows(df, budget=200)).collect(), key=lambda r: (r.conv_id or 0, r.window)):
        got[r.conv_id].append(r)
    assert len(got[1]) > 5 and all(r.text.startswith("<|im_start|>system\nbe kind") for r in got[1])
    want = defaultdict(list)
    for c, t, role, text in turns:
        want[c].append((role or "", text or ""))
    for c, rows in want.items():
        assert [(t.role, t.text) for r in got[c] for t in r.turns] == rows
        assert "".join(r.loss_text for r in got[c]) == "".join(x for role, x in rows if role == "assistant")
    assert chat.windows(df.limit(0)).count() == 0


def test_media_formats(spark):
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (13, 9, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_netpbm(image)) == image).all()
    assert (media.decode_image(media.encode_bmp(image)) == image).all()
    assert (media.decode_image(b"P2 # c\n2 2\n255\n0 9\n255 7\n")[:, :, 0] == [[0, 9], [255, 7]]).all()
    assert (media.decode_image(b"P1\n2 2\n1001\n")[:, :, 0] == [[0, 255], [255, 0]]).all()
    assert (media.decode_image(b"P4\n2 2\n\x80\x40")[:, :, 0] == [[0, 255], [255, 0]]).all()
    tall = r.integers(0, 256, (12, 8, 1), dtype=np.uint8)
    assert (media.resize(tall, 6, 4)[:, :, 0] == np.floor(tall.reshape(6, 2, 4, 2).mean((1, 3)) + 0.5)).all()
    df = spark.createDataFrame([(1, media.encode_bmp(image)), (2, b"P6 broken"), (3, None), (4, b"BM")], "k long, media binary")
    rows = {x.k: x for x in media.describe(df).collect()}
    assert rows[1].width == 9 and len(rows[1].dhash) == 16 and rows[2].tile is None and rows[3].dhash is None and rows[4].width is None
    assert np.load(__import__("io").BytesIO(bytes(rows[1].tile))).shape == (16, 16, 3)


def test_media_texts(docs, rows, empty):
    got = {r.id: r for r in media.read_back(media.store_texts(docs)).collect()}
    assert media.read_back(media.store_texts(empty)).count() == 0
    for i, t in rows:
        b = (t or "").encode()
        payload = b + b" " * (-len(b) % 192 if b else 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-16:]))


def test_quality(spark):
    path = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "labels.parquet")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).drop("text")
    held = scored.join(labels, "doc_id").where(quality.held_out("doc_id")).toPandas()
    said = held.score >= quality.THRESHOLD
    assert said[held.quality == 1].mean() > 0.98 and (~said)[held.quality == 0].mean() > 0.8


def test_quality_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None and quality.score(empty, None).count() == 0
    got = {r.text: r.score for r in quality.score(docs, None).select("text", "score").collect()}
    assert got[None] == got[""] == got[" "] == 0 and got["a b"] == 1

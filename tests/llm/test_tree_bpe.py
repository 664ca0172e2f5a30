"""Tree concatenation against the tokenizers library."""

import os
import random

import numpy as np
import pytest

from tessera.llm import tree_bpe
from test_operators import sha


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf,piece", [(tree_bpe.LEAF, tree_bpe.PIECE), (64, 16), (9, 1 << 10)])
def test_same_as_library(spark, docs, rows, library, leaf, piece, monkeypatch):
    monkeypatch.setattr(tree_bpe, "PIECE", piece)
    odd = [(1, "a  <|endoftext|>  b<|endoftext|><|endoftext|>\n\n"), (2, "<|endoftext|"), (None, "x" * 500 + "<|endoftext|>" + "!?" * 300), (None, "x" * 500 + "<|endoftext|>" + "!?" * 300), (2, "<|endoftext|"), (3, "\U00010d4aꟚ new letters")]
    held = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(i, t, 0) for i, t in odd], "doc_id long, text string, id long"))
    got = sorted(((r.id is None, r.id or 0), r.n_tokens, r.ids, r.decoded) for r in tree_bpe.round_trip(held, leaf=leaf).collect())
    expected = []
    for i, t in [*rows, *odd]:
        ids, text = want(library, t)
        expected.append(((i is None, i or 0), len(ids), ids, text))
    assert got == sorted(expected)
    assert all(a[3] == (t or "") for a, t in zip(got, [t for _, t in sorted([*rows, *odd], key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))], strict=True) if a[0][1] > 50)


def test_random_texts(library, monkeypatch):
    """Awkward pieces, halved down to three bytes, so most tokens cross a join."""
    monkeypatch.setattr(tree_bpe, "PIECE", 3)
    known, r = tree_bpe._vocabulary(None), random.Random(3)
    parts = ["a", "b", " ", "\n", "'", "s", "re", "é", "日", "1", "!", "<|endoftext|>", "<|", "  ", "the", "ing", "̀", "　", "ÿ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(r.choice(["a", "aa", "th", "ing", "e", "o"]) for _ in range(r.randint(0, 200))) for _ in range(500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends = tree_bpe.stretches(data, offsets, known)
    ids, n = tree_bpe.encoded(data, starts, ends, known)
    at = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == expected


def test_classes_are_the_librarys(library):
    """Each code point stands between letters, digits and marks."""
    known = tree_bpe._vocabulary(None)
    r = random.Random(4)
    points = sorted({*range(0x80, 0x3000), *r.sample([c for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000], 20_000)})
    text = "".join(f"a{chr(c)}0{chr(c)}!{chr(c)} " for c in points)
    data = np.frombuffer(text.encode(), np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    starts, _ = tree_bpe.stretches(data, np.array([0, len(data)]), known)
    assert np.searchsorted(heads, starts).tolist() == [at[0] for _, at in library.pre_tokenizer.pre_tokenize_str(text)]


def test_windows_grow_until_both_sides_agree(library):
    """A run of one letter shifts all tokens behind a join; its window must reach the end."""
    known = tree_bpe._vocabulary(None)
    for left, right in (("a" * 21, "a" * 333), ("a" * 1000, "a" * 7), ("", "a"), ("a", "")):
        a, b = (library.encode(x, add_special_tokens=False).ids for x in (left, right))
        assert tree_bpe.join([(a, b)], known, 1) == [library.encode(left + right, add_special_tokens=False).ids]


def test_long_word_of_many_leaves(spark, library):
    r = random.Random(8)
    text = "".join(r.choice("abcdefghij") for _ in range(700_001)) + " end"
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(None, text)], "doc_id long, text string")
    out = tree_bpe.round_trip(docs).collect()
    ids, _ = want(library, text)
    assert len(out) == 21 and all(x.ids == ids and x.decoded == text for x in out)


def test_decode(spark, empty, library):
    assert tree_bpe.round_trip(empty).count() == 0
    lists = [[50256, 0, 255], [], None, [220] * 3, [98]]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, ids array<int>")
    got = {r.id: r.decoded for r in tree_bpe.decode(df).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="not in the vocabulary"):
        tree_bpe.decode(spark.createDataFrame([(1, [50257])], "id long, ids array<int>")).collect()


def test_query_digests(spark, library):
    import __spark_entry__
    from test_oracles import DATA

    got = {r.doc_id: tuple(r)[1:] for r in __spark_entry__.queries()["op12_tree_bpe"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids, text = want(library, r.text)
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(text))
    assert not got

"""Odd rows in every pipeline stage: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import random

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, spans string, kept binary, bin long, family long"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    """A folder whose labels name no document, so that quality rejects by words alone."""
    path = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(10**9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, 0.5, "x", b"y", 2, 3) for i, t in rows], SCHEMA)


def prose(seed, n=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


ROWS = [(None, None), (None, "a b c"), (None, "a b c"), (1, None), (2, ""), (3, " \n"), (4, prose(1)), (5, prose(2)), (5, prose(2)), (6, prose(3, 150_000))]


def kept(spark, labels, name, rows):
    out = STAGES[name](spark, frame(spark, rows), labels)
    if name != "best-fit packing":
        assert out.columns == list(pipeline.COLUMNS)
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    return out.collect()


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, labels, name):
    assert kept(spark, labels, name, []) == []


def test_quality(spark, labels):
    got = kept(spark, labels, "quality classifier", ROWS)
    assert got == sorted([x for x in ROWS if x[1] and x[1].strip()], key=str)


def test_near_dedup(spark, labels):
    got = kept(spark, labels, "minhash near-dedup", [*ROWS, (9, prose(1) + " more")])
    assert got == sorted(ROWS, key=str)


def test_repeats(spark, labels):
    whole = prose(4, 40)
    long = prose(3, 150_000)
    rows = [*ROWS, (20, "�" + whole + "é�"), (21, "�é" + whole + "x�"), (22, whole), (23, long[:90_000] + "end")]
    plain = kept(spark, labels, "suffix-array dedup", rows)
    got = dict(plain)
    assert plain.count((None, "a b c")) == 2 and plain.count((None, "")) == 1
    # rows of one id start at the same places, so neither repeats the other there
    assert plain.count((5, prose(2))) == 2
    assert got[20] == "�" + whole + "é�" and got[21] == "�éx�" and 22 not in got
    assert got[23] == "end" and got[6] == long and got[1] == "" and got[2] == "" and got[3] == " \n"


def test_cut_characters_go_whole(spark, labels):
    # the euro sign and its neighbour share the first two bytes, so the repeat ends inside a character
    shared = prose(5, 40)
    rows = [(1, shared + "€1"), (2, shared + "₭�2"), (3, "�" + shared + "₮")]
    got = dict(kept(spark, labels, "suffix-array dedup", rows))
    assert got == {1: shared + "€1", 2: "�2", 3: "�"}


def test_secrets(spark, labels):
    got = kept(spark, labels, "secret scans", [*ROWS, (7, "password: abcdefgh")])
    assert got == sorted([*ROWS, (7, "[secret]")], key=str)


def test_packing(spark, labels):
    got = kept(spark, labels, "best-fit packing", ROWS)
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.doc_id is None for r in got) == 3 and {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6}

"""Adaptive bursts and the co-change stream: order, batches and replays change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import bursts as B
from tessera.streaming.co_change import CoChange, cold


def waits(*times):
    t = B.Tracker()
    return [t.update(x) for x in times]


def test_tracker():
    assert waits(10, 20, 30, 40) == [200, 200, 200, 500]
    assert waits(10, 20, 30) == [200, 200, 200]
    assert waits(10, 20, 30, 40, 350) == [200, 200, 200, 500, 200]
    assert waits(0, 200, 201) == [200, 200, 200] and waits(0, 50, 100, 200) == [200, 200, 200, 500]
    t = B.Tracker()
    for x in (10, 20, 30, 40):
        t.update(x)
    assert t.wait(40, 100) == 500 and t.wait(40, 5040) == 500 and t.wait(40, 5041) == 200


def test_bursts_at_once():
    assert B.bursts([(0, "a"), (150, "b"), (300, "c"), (800, "d")], 2000) == [(0, 300, 3, "c", 200), (800, 800, 1, "d", 200)]
    assert B.bursts([(0, "a"), (10, "b"), (20, "c"), (30, "d"), (520, "e"), (730, "f")], 5000) == [(0, 520, 5, "e", 200), (730, 730, 1, "f", 200)]
    assert B.bursts([(0, "a")], 199) == [] and B.bursts([(0, "a")], 200) == [(0, 0, 1, "a", 200)]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_of_bursts(spark, tmp_path, files):
    r = random.Random(7)
    events, at = [], 1_700_000_000_000
    for _ in range(400):
        at += r.choice([5, 20, 60, 190, 210, 450, 600, 7000])
        events.append((f"p{r.randint(0, 5)}", f"op{len(events):03}", at))
    size = -(-len(events) // files)
    for i in range(files):
        part = events[i * size : (i + 1) * size]
        r.shuffle(part)  # late within a file
        frame = spark.createDataFrame(part, "path string, op string, ms long").select("path", "op", F.timestamp_millis("ms").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = B.drained(B.adaptive(stream, late="1 millisecond"), spark, str(tmp_path / "out"))
    rows = sorted((x.path, x.a, x.b, x.events, x.op, x.wait_ms) for x in got.select("path", F.unix_millis("first_ts").alias("a"), F.unix_millis("last_ts").alias("b"), "events", "op", "wait_ms").collect())
    reached = max(t for *_, t in events) - 1
    want = sorted((p, *b) for p in {e[0] for e in events} for b in B.bursts([(t, o) for q, o, t in events if q == p], reached))
    assert rows == want and {w[-1] for w in want} == {200, 500}


def commits(n, seed=3):
    r = random.Random(seed)
    day = datetime(2024, 1, 1)
    return [(f"c{i}", day + timedelta(days=3 * i, seconds=r.randint(0, 9)), r.sample([f"f{k}" for k in range(9)], r.randint(1, 4))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "oid string, ts timestamp, paths array<string>")


def rounded(df):
    return sorted((x.a, x.b, x.shared, float(f"{x.weight:.11g}"), x.last_ts) for x in df.collect())


def test_co_change_batches_and_replays(spark, tmp_path):
    every = commits(60)
    kept = CoChange(spark, str(tmp_path), days=90)
    assert kept.state().count() == 0
    for n in range(4):
        part = frame(spark, every[15 * n : 15 * n + 15] + every[15 * n - 2 : 15 * n] * (n > 0))  # some come again
        kept.apply(part, n)
        want = rounded(cold(frame(spark, every[: 15 * n + 15]), days=90))
        assert rounded(kept.state()) == want
        if n in (1, 3):  # a batch that runs again, also one that commits have left since
            kept.apply(part, n)
            assert rounded(kept.state()) == want
    kept.apply(frame(spark, []), 4)
    assert rounded(kept.state()) == want
    half = {(x.a, x.b): x.weight for x in kept.state().collect()}
    assert all(abs(x.weight - half[x.a, x.b] * 2 ** (-(datetime(2024, 8, 1) - datetime(2000, 1, 1)).days / 30)) < 1e-9 for x in kept.weighted("2024-08-01 00:00:00").collect())


def test_co_change_after_a_batch_that_died(spark, tmp_path):
    """Folders of a batch that never reached its fence don't count, and are overwritten."""
    every = commits(30, 5)
    kept = CoChange(spark, str(tmp_path), days=45)
    kept.apply(frame(spark, every[:15]), 0)
    broken = CoChange(spark, str(tmp_path), days=45)
    write = broken._write
    broken._write = lambda rows, name, number: (_ for _ in ()).throw(RuntimeError("lost")) if name == "touched" else write(rows, name, number)
    with pytest.raises(RuntimeError):
        broken.apply(frame(spark, every[15:22]), 1)
    assert rounded(kept.state()) == rounded(cold(frame(spark, every[:15]), days=45))
    kept.apply(frame(spark, every[15:]), 1)
    assert rounded(kept.state()) == rounded(cold(frame(spark, every), days=45))


def test_co_change_stream(spark, tmp_path):
    every = commits(24, 9)
    for i in range(3):
        frame(spark, every[8 * i : 8 * i + 8]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("oid string, ts timestamp, paths array<string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = CoChange(spark, str(tmp_path / "state"), days=30)
    kept.sink(stream, str(tmp_path / "checkpoint")).start().awaitTermination()
    assert rounded(kept.state()) == rounded(cold(frame(spark, every), days=30))

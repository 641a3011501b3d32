import random

import pytest
from pyspark.sql import functions as F
from test_seen import replay

from pagetrove.streaming import seen
from pagetrove.streaming.seen import ROCKSDB, drop_seen, seen_in_order, seen_stream

SCHEMA = "key string, t long, id long"


def in_batches(spark, path, rows, size):
    """Parquet files that arrive in time order."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.parquet(f"{path}/{i:06d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def sightings():
    rng = random.Random(3)
    times = sorted(rng.randrange(4_000) for _ in range(200))
    return [(rng.choice("abc"), t, i) for i, t in enumerate(times)]


def test_stream_equals_replay(spark, tmp_path):
    rows = sightings()
    out = str(tmp_path / "out")
    stream = in_batches(spark, str(tmp_path / "in"), rows, 30)
    query = (
        seen_stream(stream, 600, lateness=1).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "progress")).option("path", out)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) > 3
    got = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).select("key", "t", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == replay(rows, 600)


def test_watermark_form_never_repeats_within_ttl(spark, tmp_path):
    rows = sightings()
    stream = in_batches(spark, str(tmp_path / "in"), rows, 70).withColumn("ts", F.timestamp_seconds("t"))
    query = (
        drop_seen(stream, "key", "ts", 600)
        .writeStream.format("memory").queryName("kept").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = sorted((r.key, r.t) for r in spark.table("kept").collect())
    assert {k for k, _ in kept} == {"a", "b", "c"}
    assert all(b[1] - a[1] >= 600 for a, b in zip(kept, kept[1:]) if a[0] == b[0])
    assert all((k, min(t for key, t, _ in rows if key == k)) in kept for k in "abc")


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    yield
    spark.conf.set(ROCKSDB[0], before)


def test_in_order_form_equals_replay_whatever_the_batches(spark, tmp_path, rocksdb):
    """Rows out of order within the lateness, a hot key, a restart from the checkpoint, rows that come too late."""
    rng = random.Random(9)
    ttl, lateness = 60_000, 30_000
    rows = [(rng.choice("abbbbb"), rng.randrange(1, 1_000_000), i) for i in range(500)]
    rows += [("hot", t * 37 + 1, 1_000 + t) for t in range(600)]
    # Arrival is late by less than the lateness allows.
    rows.sort(key=lambda r: r[1] + rng.randrange(lateness))
    late = [("a", 5, 9_000), ("new", 10, 9_001)]
    end = [(None, 10_000_000_000, 0)]
    path, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    parts = [rows[:300], rows[300:500], rows[500:800], rows[800:], end, late, end]

    def run(upto):
        for i, part in enumerate(parts[:upto]):
            if not (tmp_path / "in" / f"{i:02d}").exists():
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/{i:02d}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
        query = (
            seen_in_order(stream, ttl, lateness).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", progress).option("path", out).trigger(availableNow=True).start())
        query.awaitTermination()

    run(2)
    run(len(parts))  # a second query takes up the state of the first
    got = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).select("key", "t", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == replay(rows, ttl)


@pytest.mark.parametrize("piece", [4, 5])
def test_in_order_form_in_short_pieces(spark, tmp_path, rocksdb, monkeypatch, piece):
    """What waits is split and taken in pieces; rows go before, between and into the pieces that are there."""
    monkeypatch.setattr(seen, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = [("k" if i % 9 else "rare", rng.randrange(1, 60_000), i) for i in range(250)]
    rows.sort(key=lambda r: r[1] + rng.randrange(20_000))
    rows = [(k, t, i) for k, t, i in rows] + [("k", rows[-1][1], 999), (None, 10**10, 0)]
    out = str(tmp_path / "out")
    query = seen_in_order(in_batches(spark, str(tmp_path / "in"), rows, 90), 700, 20_000).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "progress")).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).select("key", "t", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == replay(rows[:-1], 700)

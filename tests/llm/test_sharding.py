import zlib

import pytest
from pyspark.sql import functions as F

from pagetrove.llm import queries, sharding


def check(rows, texts, shards, slack):
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for row in rows:
        sizes[row.shard] += row.size
        slots[row.shard].append(row.slot)
    for own in slots:
        assert sorted(own) == list(range(len(own)))
    assert max(sizes) - min(sizes) <= slack
    assert sum(sizes) == sum(8 + len((t or "").encode()) for t in texts)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_sharding(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    largest = max(len(t.encode()) for t in texts.values()) + 8
    check(rows, texts.values(), 24, 2 * largest)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


@pytest.mark.parametrize("chunk_rows", [100_000, 10])
def test_hot_text_nulls_and_ties(spark, documents, monkeypatch, chunk_rows):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", chunk_rows)
    pairs = [(i, "same text") for i in range(600)] + [(i, f"text {i} é" * (i % 7)) for i in range(600, 1200)]
    pairs += [(None, None), (None, "x"), (7, "same text"), (5000, "")]
    docs = documents(pairs).withColumnRenamed("n_chars", "slot")
    out = sharding.shard(docs, 5)
    rows = out.collect()
    assert len(rows) == len(pairs) and set(out.columns) == {"doc_id", "text", "lang", "source", "size", "shard", "slot"}
    check(rows, [t for _, t in pairs], 5, 200)


def test_empty(documents):
    assert sharding.shard(documents([]), 3).count() == 0


def test_texts_move_with_their_rows(spark, sf_dir, monkeypatch):
    real = sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda *a: real(*a).withColumn("text", F.concat(F.lit("out "), "text")))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_sharding(spark, sf_dir).collect()
    assert all(r.text_crc32 == zlib.crc32(f"out {texts[r.doc_id]}".encode()) for r in rows)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 500])
def test_chunks_by_bytes(documents, monkeypatch, chunk_bytes):
    monkeypatch.setattr(sharding, "CHUNK_BYTES", chunk_bytes)
    texts = [f"text {i} " * (i % 50) for i in range(400)]
    rows = sharding.shard(documents(list(enumerate(texts))), 3).collect()
    check(rows, texts, 3, 1000)
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(texts))


def test_inner_names_as_columns(documents):
    docs = documents([(i, f"text {i % 9}") for i in range(60)])
    plain = sharding.shard(docs, 4).select("doc_id", "shard", "slot").collect()
    for name in ("row", "h", "d", "chunk", "local", "first", "_first", "_h", "count"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), "text"))
    out = sharding.shard(docs, 4)
    assert sorted(out.select("doc_id", "shard", "slot").collect()) == sorted(plain)
    assert out.where("h != concat('h ', text) or _first != concat('_first ', text) or row != concat('row ', text)").isEmpty()
    assert set(out.columns) == {*docs.columns, "size", "shard", "slot"}

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from pagetrove.llm import queries, simhash


def fingerprint(text, width=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=2):
    """Brute force over distinct fingerprints; fps: id -> fingerprint."""
    root = {f: f for f in fps.values()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(list(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[top(a)] = top(b)
    least = {}
    for key, f in fps.items():
        least[top(f)] = min(least.get(top(f), key), key)
    return {key: least[top(f)] for key, f in fps.items()}


def test_query(spark, sf_dir):
    fps = {r.doc_id: fingerprint(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = components(fps)
    rows = queries.op5_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        k: (f"{f:016x}", want[k]) for k, f in fps.items()}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_collides(radius):
    tables = simhash.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for bits in combinations(range(64), radius):
        differ = sum(1 << b for b in bits)
        assert any(not mask & differ for mask in tables)


@pytest.mark.parametrize("limit", [8_192, 20])
def test_chains_and_large_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    chance = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        fp = chance.getrandbits(64)
        for _ in range(60):
            fps.add(fp)
            for bit in chance.sample(range(64), chance.choice([1, 2, 2, 3])):
                fp ^= 1 << bit
    center = chance.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 64, 3), 2)}
    named = dict(enumerate(sorted(fps)))
    want = components(named)
    signed = {simhash._signed(f): k for k, f in named.items()}
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(signed[r.a], signed[r.b]) for r in simhash.near_links(classes, 2).collect()]
    assert all((named[a] ^ named[b]).bit_count() <= 2 or want[a] == want[b] for a, b in links)
    label = {k: k for k in named}
    for _ in range(len(named)):
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert label == want


def test_nulls_ties_and_clashing_columns(spark, documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    pairs = [(5, "A b C d"), (3, "a B c D"), (9, None), (8, ""), (7, " \t"), (None, "a b c d"), (3, "a B c D"),
             (11, "one"), (12, "One"), (20, long), (21, long + " end")]
    docs = documents(pairs).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component")
    rows = simhash.cluster(docs, 3, 2).collect()
    got = {(r.doc_id, r.component_id) for r in rows}
    assert len(rows) == len(pairs)
    assert got == {(5, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (11, 11), (12, 11), (20, 20), (21, 20)}
    kept = simhash.keep_one(docs, 3, 2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [11, 20, 3, 3, 7, None]
    assert simhash.cluster(documents([]), 3, 2).count() == 0


def test_a_repeated_id_loses_only_the_copy(documents):
    one = " ".join(f"alpha{i} beta{i * 7}" for i in range(60))
    other = " ".join(f"gamma{i * 3} delta{i}" for i in range(60))
    kept = simhash.keep_one(documents([(1, one), (2, one), (2, other), (3, None)]), 3, 2).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, one), (2, other), (3, "")]


def test_inner_names_as_columns(documents):
    docs = documents([(1, "a b c d"), (2, "A b c d"), (3, "e f g h")])
    for name in ("_text_hash", "hash", "row", "id", "words", "fp", "component_id"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), "text"))
    kept = simhash.keep_one(docs, 3, 2)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r._text_hash, r.id) for r in kept.collect()} == {
        (1, "_text_hash a b c d", "id a b c d"), (3, "_text_hash e f g h", "id e f g h")}

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrove.llm import negatives, queries

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, k=10):
    """Every anchor against every row, in Python's integers."""
    clean = {}
    for own, vector, label in rows:
        if own is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        clean[own] = min(clean.get(own, whole), whole)
    out = []
    for a, (label, u) in clean.items():
        if not is_anchor(a):
            continue
        scores = [(-sum(x * y for x, y in zip(u, v)), b, other) for b, (other, v) in clean.items() if len(u) == len(v)]
        scores.sort()
        for ps, p, _ in [s for s in scores if s[2] == label and s[1] != a][:positives]:
            near = [s for s in scores if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:k]
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(near, 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(params=["whole lists", "slices of one block"])
def sizes(request, monkeypatch):
    if request.param != "whole lists":
        for name, value in {"LIST": 1, "ROWS": 20, "MEMBERS": 3, "CHUNK": 4, "SUMMARY_BYTES": 500}.items():
            monkeypatch.setattr(negatives, name, value)


def test_query_equals_brute_force(spark, sf_dir, sizes):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    frame = queries.op11_negatives(spark, sf_dir)
    assert dict(frame.dtypes) == {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
        "positive_score": "bigint", "negative_score": "bigint"}
    assert got(frame) == brute(rows, lambda i: i % 100 == 0)


def test_edges(spark, sizes):
    chance = random.Random(8)
    rows = []
    for i in range(240):
        base = [[1, 0, 0], [0.6, 0.8, 0], [-1, 0.1, 0], [0, 0, 0], [0.2, -0.7, 1]][i % 5]
        rows.append((i, [float(x + chance.choice([0, 0, 0.01, 0.3])) for x in base], i % 3))
    rows += [(1000 + i, [0.5, 0.5, 0.5], i % 2) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2010, [1.0, 0.0, 0.0], None), (2020, [None, 1.0, 1.0], 0), (2030, [float("nan"), 0.0, 1.0], 0),
             (2040, [float("inf"), 0.0, 1.0], 0), (None, [1.0, 0.0, 0.0], 0), (2050, [], 0), (2060, [], 1), (2070, [], 0),
             (2080, [1.0, 0.5], 0), (2081, [1.0, 0.4], 0), (2082, [0.6, 0.4], 1), (2090, [5.0, 0.0, 0.0], 77),
             (0, [9.0, 9.0, 9.0], 2), (10, [0.1, 0.1, 0.1], 0), (10, [0.1, 0.1, 0.1], 0), (-10, [0.9, 0.1, 0.0], -3),
             (-11, [0.8, 0.1, 0.0], -3)]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "label AS v", "label AS cell", "label AS block", "label AS rank")
    assert got(negatives.mine(frame.repartition(6), F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_empty_table(spark):
    empty = negatives.mine(spark.createDataFrame([], ROWS), F.col("vec_id") % 100 == 0)
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert empty.count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], ROWS)
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + i), float(2**21 - 3 * i), -float(2**19)], i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, ROWS)
    assert got(negatives.mine(frame, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_walks_end_early():
    """Members near their centre see few of the candidates, and what they find is the best."""
    chance = np.random.default_rng(1)
    centre = np.eye(32)[0]
    near = lambda n, wide: np.round(1000 * negatives._unit(centre + wide * chance.normal(size=(n, 32)))).astype(int)
    members, close = near(40, 0.01), near(300, 0.02)
    far = np.round(1000 * negatives._unit(chance.normal(size=(20_000, 32)))).astype(int)
    unpack = lambda ids, v: negatives._unpack(np.array(ids, "<i8").tobytes(), v.astype("<i8").tobytes(), 8, 32)
    windows = [{"anchor_id": i, "positive_id": None, "positive_score": None, "low": -negatives.ANY, "high": negatives.ANY} for i in range(40)]
    angle = negatives._angles(members.astype(float), centre).max()
    walk = negatives.Walk(unpack(range(40), members), centre, angle, windows, 10)
    pool = np.concatenate([close, far])
    places = np.arange(100, 100 + len(pool))
    bounds = negatives._bound(np.linalg.norm(pool, axis=1), negatives._angles(pool.astype(float), centre) - angle)
    order = np.argsort(-bounds)
    for at in range(0, len(pool), 500):
        chunk = order[at : at + 500]
        walk.take(unpack(places[chunk], pool[chunk]), bounds[chunk[0]])
    assert walk.done and walk.read < 40 * len(pool) / 20
    scores = members @ pool.T
    want = sorted((i, places[j], scores[i, j]) for i in range(40) for j in np.lexsort((places, -scores[i]))[:10])
    assert sorted((a, b, s) for a, _, _, b, s in walk.found()) == want

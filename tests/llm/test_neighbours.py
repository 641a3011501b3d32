import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrove.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<double>, label int, component string"


def usable(row):
    key, vec, label = row[:3]
    return (key is not None and label is not None and vec is not None and len(vec) > 0
            and all(x is not None and np.isfinite(x) for x in vec) and any(vec))


def expected(rows, threshold=0.98):
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / np.abs(a[1]).max(), np.array(b[1]) / np.abs(b[1]).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = rows[i][0] if not usable(rows[i]) else min(rows[k][0] for k in seen)
        out.append((rows[i][0], len(links[i]), least, least is None or rows[i][0] == least))
    return sorted(out, key=repr)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op4_embeddings(spark, sf_dir).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("small", [False, True])
def test_groups_edges_and_faults(spark, monkeypatch, small):
    if small:
        for name, value in (("LEAF", 16), ("LIST", 3), ("MEETING", 8), ("BLOCK", 8)):
            monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    rows, key = [], 1000
    for label in range(3):
        for group in (1, 1, 2, 3, 40):
            center = rng.standard_normal(24)
            for _ in range(group):
                key -= 1
                vec = center + rng.standard_normal(24) * rng.choice([0.02, 0.12, 0.2])
                rows.append((key, (vec * rng.choice([1, 50])).tolist(), label, "x"))
    rows += [(2000 + i, rows[9][1], rows[9][2], "x") for i in range(5)] + [rows[10], rows[10]]
    rows += [
        (1, None, 0, "x"), (2, [], 0, "x"), (3, [0.0] * 24, 0, "x"), (4, [1.0, None] * 12, 0, "x"),
        (5, [float("nan")] * 24, 0, "x"), (6, [float("inf")] * 24, 0, "x"), (7, rows[9][1], None, "x"),
        (None, rows[9][1], rows[9][2], "x"), (8, rows[9][1][:5], rows[9][2], "x"), (9, [1e200] * 24, 0, "x"),
        (10, [2e200] * 24, 0, "x"),
    ]
    result = neighbours.cluster(spark.createDataFrame(rows, SCHEMA), 0.98)
    assert sorted(map(tuple, result.rows.collect()), key=repr) == expected(rows)
    assert result.recall >= 0.999


def test_far_neighbours_stay_in_lists_and_audit_counts_classes_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    unit = neighbours._unit(list(rng.standard_normal((20, 24))))
    edges = neighbours._compare(np.arange(20), unit, 0.98, 4)
    assert sorted(a for a, _, _ in edges) == sorted(4 * list(range(20)))
    monkeypatch.setattr(neighbours, "_counts", lambda members, threshold: members.select(
        "cid", F.when(F.col("copies") > 1, 1).otherwise(0).cast("long").alias("links")))
    centre = rng.standard_normal(24)
    rows = [(i, (centre + rng.standard_normal(24) * 0.001).tolist(), 0, "x") for i in range(4)]
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.cluster(spark.createDataFrame(rows, SCHEMA), 0.98)


def expected_of_clean(rows, threshold=0.98):
    """``expected`` for many usable rows of one label, as a matrix."""
    vecs = np.array([r[1] for r in rows])
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    linked = vecs @ vecs.T >= threshold
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in rows])
    least = ids.copy()
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], ids.max()).min(axis=1))
        if (lower == least).all():
            break
        least = lower
    return sorted(zip(ids.tolist(), linked.sum(axis=1).tolist(), least.tolist(), (ids == least).tolist()), key=repr)


def groups_with_one_bridge(rng, sizes, dim=32):
    """Groups of near copies; neighbours in the list are linked by a single pair."""
    first, rows = rng.standard_normal(dim), []
    first /= np.linalg.norm(first)
    for n, size in enumerate(sizes):
        side = rng.standard_normal(dim)
        side -= side @ first * first
        side /= np.linalg.norm(side)
        center = np.cos(0.5) * first + np.sin(0.5) * side
        vecs = [center + rng.standard_normal(dim) * 0.008 for _ in range(size)]
        # Steps from the common direction to the group: the first stands 0.06 from it, so two groups touch there.
        vecs += [np.cos(x) * first + np.sin(x) * side for x in (0.06, 0.2, 0.34)]
        rows += vecs
    order = rng.permutation(len(rows))
    return [(int(i), rows[k].tolist(), 0, "x") for i, k in enumerate(order)]


@pytest.mark.parametrize("sizes", [(600, 600), (150, 40, 300)])
def test_saturated_groups_keep_their_bridge(spark, sizes):
    rng = np.random.default_rng(8)
    rows = groups_with_one_bridge(rng, sizes)
    result = neighbours.cluster(spark.createDataFrame(rows, SCHEMA), 0.98)
    assert sorted(map(tuple, result.rows.collect()), key=repr) == expected_of_clean(rows)


def test_bridge_between_saturated_ends(spark):
    """Both ends of the only link between two groups have more than LIST closer neighbours."""
    rng = np.random.default_rng(9)
    dim, rows = 32, []
    axis, side = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    # Cosine 0.98 is an angle of 0.2003. Two groups 0.25 apart, of which one member each is shifted inwards.
    for at, inward in ((0.0, 0.026), (0.25, 0.224)):
        for k in range(600):
            angle = inward if k == 0 else at
            noise = 0.0 if k == 0 else 0.003
            rows.append((np.cos(angle) * axis + np.sin(angle) * side) + rng.standard_normal(dim) * noise)
    x = neighbours._unit(rows)
    linked = x[:600] @ x[600:].T >= 0.98
    assert linked.sum() == 1 and (x[0] @ x[:600].T >= 0.98).sum() > neighbours.LIST
    rows = [(int(i), x[k].tolist(), 0, "x") for i, k in enumerate(rng.permutation(1200))]
    result = neighbours.cluster(spark.createDataFrame(rows, SCHEMA), 0.98)
    got = sorted(map(tuple, result.rows.collect()), key=repr)
    assert len({r[2] for r in got}) == 1 and got == expected_of_clean(rows)


def test_empty(spark):
    assert neighbours.cluster(spark.createDataFrame([], SCHEMA), 0.98).rows.count() == 0


def test_enlarged_lists_find_the_bridge(spark):
    """The step alone: lists hold the LIST best of the own group, and the groups are components so far."""
    rng = np.random.default_rng(9)
    axis, side = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    rows = []
    for at, inward in ((0.0, 0.026), (0.25, 0.224)):
        for k in range(200):
            angle, noise = (inward, 0.0) if k == 0 else (at, 0.003)
            rows.append(np.cos(angle) * axis + np.sin(angle) * side + rng.standard_normal(32) * noise)
    x = neighbours._unit(rows)
    cosine = x @ x.T
    linked = {(int(i), int(j)) for i, j in np.argwhere(cosine >= 0.98) if i // 200 != j // 200}
    assert linked
    members = spark.createDataFrame(
        [(i, i // 200, "0", 32, x[i].tolist()) for i in range(400)],
        "cid long, component long, label string, dim int, vec array<double>")
    lists = spark.createDataFrame(
        [(i, int(j), float(cosine[i, j]), True) for i in range(400)
         for j in sorted(set(range(i // 200 * 200, i // 200 * 200 + 200)) - {i}, key=lambda j: -cosine[i, j])[: neighbours.LIST]],
        "a long, b long, cosine double, old boolean")
    found = {(r.a, r.b) for links in neighbours._between(lists, members, 0.98) for r in links.collect()}
    assert found and found <= linked

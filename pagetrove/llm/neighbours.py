"""Embedding near-duplicates by NN-descent.

Vectors are compared only under equal labels. Equal vectors are one class. The neighbour graph
starts from the leaves of random projection trees: classes sorted by the signs of random projections,
compared LEAF by LEAF. It is refined through neighbours of neighbours: all that list a class or
are listed by it meet at that class and are compared there if one of them is new to it, until no new entry is a
link and few are new at all. A list holds LIST neighbours.

A list of LIST links is saturated: it says nothing about what lies outside its dense group. Such lists are
enlarged by places for classes of other components, FAR of each and WIDE in all. The places are filled
from representatives of the components and refined in the same way, new entries only. A link found
there merges two components, whose places are then free for others, so the enlarged part never fills up with
links and its size does not grow with the group. This goes on until no component merges.

An audit compares a bounded sample of classes with all
vectors; while fewer than RECALL of their true links are found, the mean over those that have any, more
trees and rounds follow, and after MORE attempts the job fails.

What is linked has been compared in double precision. No group is gathered: leaves, meetings and blocks
have a bounded number of rows, and dense groups yield links that span them, not all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do
rows with a null label or a null id (component null for a null id). Vectors of different length are never compared. Repeated rows are
vectors of their own. An empty table gives an empty result. Other input columns are not read.
"""

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import assign_id
from ..session import settle
from .components import components
from .shipping import map_arrow, ship

TREES = 8
SIGNS = 40
LEAF = 256
LIST = 12
MEETING = 64
BLOCK = 512
AUDIT = 512
RECALL = 0.999
MORE = 3
CHANGED = 0.001
FAR = 4
WIDE = 48
ENVOYS = 8
UNMEASURED = -2.0
OUT = 20000

EDGE = "a long, b long, cosine double"
EDGE_FIELDS = [("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())]


class Result(NamedTuple):
    rows: DataFrame
    recall: float


def _columns(columns: list[np.ndarray], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return _columns(list(zip(*rows)) if rows else [[] for _ in fields], fields)


def _rows_of(batch: pa.RecordBatch):
    lists = [pa.types.is_list(c.type) for c in batch.columns]
    return zip(*[c.to_numpy(zero_copy_only=False) if x else c.to_pylist() for c, x in zip(batch.columns, lists)])


def _array(parts: list[pa.Array]) -> np.ndarray:
    """Values of a column; lists, which are of one length, become the rows of a matrix."""
    if not pa.types.is_list(parts[0].type):
        return np.concatenate([part.to_numpy(zero_copy_only=False) for part in parts])
    return np.concatenate([part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for part in parts])


def _runs(batches: Iterator[pa.RecordBatch], keys: int, limit: int | None = None):
    """(key, arrays of the other columns) for neighbouring rows of one key, at most ``limit`` at a time."""
    held: list[pa.RecordBatch] = []
    size, current = 0, None

    def arrays() -> list[np.ndarray]:
        return [_array([part.column(i) for part in held]) for i in range(keys, held[0].num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(column[start] for column in columns)
            if held and key != current:
                yield current, arrays()
                held, size = [], 0
            current = key
            while start < end:
                take = end - start if limit is None else min(end - start, limit - size)
                held.append(batch.slice(start, take))
                start, size = start + take, size + take
                if size == limit:
                    yield current, arrays()
                    held, size = [], 0
    if held:
        yield current, arrays()


def _written(found: Iterator[list[np.ndarray]], fields) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUT rows of what each run found."""
    held: list[list[np.ndarray]] = []
    size = 0
    for columns in found:
        if len(columns[0]):
            held.append(columns)
            size += len(columns[0])
        if size >= OUT:
            yield _columns([np.concatenate(c) for c in zip(*held)], fields)
            held, size = [], 0
    if held:
        yield _columns([np.concatenate(c) for c in zip(*held)], fields)


def _unit(vectors) -> np.ndarray:
    x = np.asarray(vectors if isinstance(vectors, np.ndarray) else np.stack(vectors), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(cosine: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``size`` largest of each row, in any order."""
    if cosine.shape[1] <= size:
        return np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape), cosine
    places = np.argpartition(-cosine, size - 1, axis=1)[:, :size]
    return places, np.take_along_axis(cosine, places, axis=1)


def _edges(ids: np.ndarray, unit: np.ndarray, threshold: float, size: int, fresh: np.ndarray | None = None,
           floor: np.ndarray | None = None) -> list[np.ndarray]:
    """Best ``size`` neighbours of each row, and links that span what is connected: a, b, cosine.

    With ``fresh``, only pairs of which one is fresh count. A row's neighbours at or below its ``floor``
    are left out; the spanning links are not.
    """
    cosine = unit @ unit.T
    cosine[ids[:, None] == ids[None, :]] = UNMEASURED
    if fresh is not None:
        cosine[~(fresh[:, None] | fresh[None, :])] = UNMEASURED
    places, values = _best(cosine, size)
    wanted = values > (UNMEASURED if floor is None else floor[:, None])
    one, column = np.nonzero(wanted)
    out = [ids[one], ids[places[one, column]], values[one, column]]
    linked = cosine >= threshold
    if not linked.any():
        return out
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    # A span link joins rows of one component; the threshold stands for its cosine.
    spans = np.flatnonzero(label != np.arange(len(ids)))
    return [np.concatenate(c) for c in zip(out, (ids[spans], ids[label[spans]], np.full(len(spans), threshold)))]


def _compare(ids: np.ndarray, unit: np.ndarray, threshold: float, size: int) -> list[tuple]:
    """The rows of ``_edges``."""
    return list(zip(*(column.tolist() for column in _edges(ids, unit, threshold, size))))


def _classes(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a class key, and classes: cid, label, dim, vec, least id, copies."""
    vec = F.col(vector).cast("array<double>")
    good = (
        F.col(key).isNotNull() & F.col(label).isNotNull() & vec.isNotNull()
        & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vec, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(key).alias("id"), F.col(label).cast("string").alias("label"), vec.alias("vec"),
        F.coalesce(good, F.lit(False)).alias("good"),
    )
    grouped = rows.where("good").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    numbered = assign_id(grouped, ["label", "least", "vec"], first=0)
    return rows, settle(numbered.select(
        F.col("id").alias("cid"), "label", F.size("vec").alias("dim"), "vec", "least", "copies"), "vector-classes")


def _in_leaves(classes: DataFrame, compare, first_tree: int, schema: str, fields) -> DataFrame:
    """What ``compare`` makes of the rows (cid, unit vectors, components) of each leaf of TREES trees."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("tree", pa.int32()), ("signs", pa.int64()), ("along", pa.float64())]
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.concatenate([
                        np.random.default_rng([tree, dim]).standard_normal((SIGNS + 1, dim))
                        for tree in range(first_tree, first_tree + TREES)])
                own = batch.filter(pa.array(dims == dim))
                unit = _unit(_array([own.column("vec")]))
                values = (unit @ planes[dim].T).reshape(own.num_rows, TREES, SIGNS + 1)
                signs = (values[:, :, :SIGNS] > 0) @ powers
                vec = pa.ListArray.from_arrays(
                    pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * np.int32(dim)), pa.array(unit.ravel()))
                for n in range(TREES):
                    placed = _columns([np.full(own.num_rows, first_tree + n), signs[:, n], values[:, n, SIGNS]], fields)
                    tree, bits, along = placed.columns
                    yield pa.RecordBatch.from_arrays(
                        [tree, own.column("label"), own.column("dim"), bits, along, own.column("cid"), vec, own.column("component")],
                        names=["tree", "label", "dim", "signs", "along", "cid", "vec", "component"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written((compare(*columns) for _, columns in _runs(batches, 3, LEAF)), fields)

    signed = map_arrow(classes.select("cid", "label", "dim", "vec", "component"), sign,
                       "tree int, label string, dim int, signs long, along double, cid long, vec array<double>, component long")
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["tree", "label", "dim", "signs", "along"]
    placed = signed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return map_arrow(placed.select("tree", "label", "dim", "cid", "vec", "component"), leaf, schema)


def _leaves(classes: DataFrame, threshold: float, first_tree: int) -> DataFrame:
    """Edges within the leaves of TREES trees."""
    def compare(ids: np.ndarray, vectors: np.ndarray, _) -> list[np.ndarray]:
        return _edges(ids, vectors, threshold, LIST)

    return _in_leaves(classes.withColumn("component", F.col("cid")), compare, first_tree, EDGE, EDGE_FIELDS)


def _lists(edges: DataFrame) -> DataFrame:
    """The LIST best neighbours of each class; a span link stands behind measured ones.

    ``edges``: a, b, cosine, old. An entry is new if no row of it is old.
    """
    best = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.max("old").alias("old"))
    return _top(best, ["a"], LIST)


def _top(edges: DataFrame, by: list[str], size: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cosine"), "b"))
    return edges.withColumn("place", place).where(F.col("place") <= size).drop("place")


def _meet(lists: DataFrame, classes: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Edges found where neighbours and reverse neighbours of a class meet, one of each pair new to it.

    What could not enter a full list, because its last entry is better, is not written; links are.
    """
    both = lists.select(F.col("a").alias("at"), F.col("b").alias("cid"), (~F.col("old")).alias("new")).unionByName(
        lists.select(F.col("b").alias("at"), F.col("a").alias("cid"), (~F.col("old")).alias("new")))
    own = lists.select(F.col("a").alias("at"), F.col("a").alias("cid"), F.lit(False).alias("new")).distinct()
    guests = both.unionByName(own).groupBy("at", "cid").agg(F.max("new").alias("new"))
    sizes = guests.groupBy("at").agg(
        F.ceil(F.count(F.lit(1)) / MEETING).alias("rooms"), F.max("new").alias("any")).where("any").drop("any")
    seated = guests.join(sizes, "at").select(
        "at", F.pmod(F.xxhash64("cid", "at", F.lit(turn)), F.col("rooms")).alias("room"), "cid", "new"
    )
    floors = lists.groupBy(F.col("a").alias("cid")).agg(
        F.when(F.count(F.lit(1)) >= LIST, F.min("cosine")).otherwise(UNMEASURED).alias("floor"))
    seated = seated.join(floors, "cid", "left").join(classes.select("cid", "vec"), "cid")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_edges(ids, _unit(vectors), threshold, LIST, fresh.astype(bool), floor)
                 for _, (ids, fresh, floor, vectors) in _runs(batches, 2))
        yield from _written(found, EDGE_FIELDS)

    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rooms = seated.select(
        "at", "room", "cid", "new", F.coalesce("floor", F.lit(UNMEASURED)).alias("floor"), "vec").repartition(parts, "at", "room").sortWithinPartitions("at", "room")
    return map_arrow(rooms, meet, EDGE)


def _rectangle(side: np.ndarray, ids: np.ndarray, home: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """a, component of a, b, component of b, cosine: the FAR best of each component for each row.

    Rows of side 0 share a component that no row of side 1 has.
    """
    near, far = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out = [[ids[:0], home[:0], ids[:0], home[:0], np.zeros(0)]]
    if not len(near) or not len(far):
        return out[0]
    unit = _unit(vectors)
    cosine = unit[near] @ unit[far].T

    def take(rows: np.ndarray, others: np.ndarray, values: np.ndarray) -> None:
        places, best = _best(values, FAR)
        a, b = np.repeat(rows, best.shape[1]), others[places.ravel()]
        out.append([ids[a], home[a], ids[b], home[b], best.ravel()])

    for component in np.unique(home[far]):
        of = np.flatnonzero(home[far] == component)
        take(near, far[of], cosine[:, of])
    take(far, near, cosine.T)
    return [np.concatenate(c) for c in zip(*out)]


FAR_EDGE = "a long, ca long, b long, cb long, cosine double"
FAR_FIELDS = [("a", pa.int64()), ("ca", pa.int64()), ("b", pa.int64()), ("cb", pa.int64()), ("cosine", pa.float64())]


def _envoys(full: DataFrame) -> DataFrame:
    """Unmeasured edges from every saturated class to the classes where its component's neighbours are entered.

    ENVOYS of each component are compared in the leaves of trees; a component enters its 2 * LIST nearest
    components at up to two classes each.
    """
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("cid"), "cid"))
    envoys = settle(full.withColumn("place", place).where(F.col("place") <= ENVOYS).drop("place"), "envoys")

    def leaf(ids: np.ndarray, vectors: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        cosine = vectors @ vectors.T
        cosine[home[:, None] == home[None, :]] = UNMEASURED
        places, values = _best(cosine, 2 * LIST * FAR)
        one, column = np.nonzero(values > UNMEASURED)
        two = places[one, column]
        return [ids[one], home[one], ids[two], home[two], values[one, column]]

    edges = _in_leaves(envoys, leaf, 0, FAR_EDGE, FAR_FIELDS)
    doors = edges.groupBy("ca", "cb", "b").agg(F.max("cosine").alias("cosine"))
    doors = _top(_top(doors, ["ca", "cb"], 2), ["ca"], 4 * LIST)
    return full.select(F.col("cid").alias("a"), F.col("component").alias("ca")).join(
        doors.select("ca", "b", "cb"), "ca").select("a", "ca", "b", "cb", F.lit(UNMEASURED).alias("cosine"))


def _visit(fresh: DataFrame, lists: DataFrame, full: DataFrame) -> DataFrame:
    """Edges found where the far neighbours that are new at a class meet those who share its component.

    Both sides are split into rooms, and each room of one meets each of the other.
    """
    ends = fresh.select(F.col("b").alias("at"), F.col("a").alias("cid")).unionByName(
        fresh.select(F.col("a").alias("at"), F.col("b").alias("cid"))).distinct()
    sites = ends.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("far_rooms"))
    inner = lists.select(F.col("a").alias("at"), F.col("b").alias("cid")).unionByName(
        lists.select(F.col("b").alias("at"), F.col("a").alias("cid"))).unionByName(
        sites.select("at", F.col("at").alias("cid"))).distinct()
    near = inner.join(sites.select("at"), "at", "left_semi")
    rooms = near.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("near_rooms")).join(sites, "at")

    def seat(rows: DataFrame, side: int) -> DataFrame:
        own, other = ("near", "far") if side == 0 else ("far", "near")
        seated = rows.join(rooms, "at").withColumn(own, F.pmod(F.xxhash64("cid"), F.col(f"{own}_rooms")).cast("int"))
        spread = seated.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_rooms") - 1)))
        return spread.select("at", "near", "far", F.lit(side).alias("side"), "cid")

    seats = seat(near, 0).unionByName(seat(ends, 1)).join(full.select("cid", "component", "vec"), "cid").select(
        "at", "near", "far", "side", "cid", "component", "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written((_rectangle(*columns) for _, columns in _runs(batches, 3)), FAR_FIELDS)

    parts = max(1, int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["at", "near", "far"]
    return map_arrow(seats.repartition(parts, *keys).sortWithinPartitions(*keys), meet, FAR_EDGE)


def _between(lists: DataFrame, members: DataFrame, threshold: float) -> list[DataFrame]:
    """Links (a, b) between components, found by the enlarged part of saturated lists."""
    saturated = lists.where(F.col("cosine") >= threshold).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= LIST)
    full = settle(members.join(saturated, F.col("cid") == F.col("a"), "left_semi").select(
        "cid", "component", "label", "dim", "vec"), "saturated")
    if len(full.select("component").distinct().take(2)) < 2:
        return []
    links = lists.where(F.col("cosine") >= threshold).select("a", "b")
    inner = settle(links.join(full.select(F.col("cid").alias("a")), "a", "left_semi").join(
        full.select(F.col("cid").alias("b")), "b", "left_semi"), "saturated-lists")
    far = settle(_envoys(full).withColumn("old", F.lit(False)), "far-lists")
    found = []
    while not far.where("not old").isEmpty():
        met = settle(_visit(far.where("not old").select("a", "b"), inner, full), "far-edges")
        found.append(met.where(F.col("cosine") >= threshold).select("a", "b"))
        every = far.where(F.col("cosine") > UNMEASURED).withColumn("old", F.lit(True)).unionByName(
            met.withColumn("old", F.lit(False)))
        best = every.groupBy("a", "ca", "b", "cb").agg(F.max("cosine").alias("cosine"), F.max("old").alias("old"))
        far = settle(_top(_top(best, ["a", "cb"], FAR), ["a"], WIDE), "far-lists")
    return [links for links in found if not links.isEmpty()]


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """cid, links: linked copies of other classes, over pairs of blocks of each component."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written((pairs(*key[1:], *columns) for key, columns in _runs(batches, 3)),
                            [("cid", pa.int64()), ("links", pa.int64())])

    def pairs(low: int, high: int, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
        unit = _unit(vectors)
        one, two = side == low, side == high
        linked = unit[one] @ unit[two].T >= threshold
        linked &= ids[one][:, None] != ids[two][None, :]
        if low == high:
            return [ids[one], linked @ copies[two]]
        return [np.concatenate([ids[one], ids[two]]), np.concatenate([linked @ copies[two], copies[one] @ linked])]

    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocked = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "cid", "copies", "vec")
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["component", "low", "high"]
    ready = cells.repartition(parts, *keys).sortWithinPartitions(*keys)
    return map_arrow(ready, count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def _audit(classes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Found links over true links, the mean over those of AUDIT classes that have any.

    Each class is compared with all vectors and counts alike, so a hot group does not outweigh pairs.
    """
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(AUDIT).join(counted, "cid", "left").select(
        "cid", "label", "dim", "vec", F.coalesce("links", F.lit(0)).alias("links")).collect()
    if not sample:
        return 1.0
    spark = classes.sparkSession
    groups: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.label, r.dim) for r in sample}:
        own = [r for r in sample if (r.label, r.dim) == key]
        groups[key] = np.array([r.cid for r in own]), _unit([np.array(r.vec) for r in own])
    queries = spark.sparkContext.broadcast(groups)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple[str, int], list] = {}
            for label, dim, cid, copies, vec in _rows_of(batch):
                own.setdefault((label, dim), []).append((cid, copies, vec))
            out = []
            for key, rows in own.items():
                if key in queries.value:
                    ids, unit = queries.value[key]
                    linked = unit @ _unit([r[2] for r in rows]).T >= threshold
                    linked &= ids[:, None] != np.array([r[0] for r in rows])[None, :]
                    links = linked @ np.array([r[1] for r in rows])
                    out += [(int(i), int(n)) for i, n in zip(ids, links) if n]
            yield _batch(out, [("cid", pa.int64()), ("links", pa.int64())])

    true = map_arrow(classes.select("label", "dim", "cid", "copies", "vec"), truth, "cid long, links long").groupBy(
        "cid").agg(F.sum("links").alias("links")).collect()
    found = {r.cid: r.links for r in sample}
    return sum(found[r.cid] / r.links for r in true) / len(true) if true else 1.0


def cluster(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> Result:
    """One row per vector: key, n_links, component_id, kept; and the audited recall."""
    ship(vectors.sparkSession)
    rows, classes = _classes(vectors, key, vector, label)
    lists, found = None, []
    for attempt in range(MORE):
        grown = settle(_leaves(classes, threshold, attempt * TREES), "neighbour-edges")
        turn = 0
        while True:
            found.append(grown.where(F.col("cosine") >= threshold).select("a", "b"))
            proposed = grown.withColumn("old", F.lit(False))
            if lists is not None:
                proposed = proposed.unionByName(lists.withColumn("old", F.lit(True)))
            lists = settle(_lists(proposed), "neighbour-lists")
            new = lists.agg(
                F.count(F.lit(1)).alias("all"), F.count_if(~F.col("old")).alias("new"),
                F.count_if(~F.col("old") & (F.col("cosine") >= threshold)).alias("links")).first()
            if not new.links and new.new <= CHANGED * new.all:
                break
            turn += 1
            grown = settle(_meet(lists, classes, threshold, turn), "neighbour-edges")
        while True:
            linked = settle(reduce(DataFrame.unionByName, found).distinct(), "neighbour-links")
            found = [linked]
            named = components(linked, "neighbour-links")
            members = settle(classes.join(named, F.col("cid") == F.col("node"), "left").select(
                "cid", "label", "dim", "vec", "least", "copies", F.coalesce("component", "cid").alias("component")), "members")
            between = _between(lists, members, threshold)
            if not between:
                break
            found += between
        counted = settle(_counts(members, threshold), "link-counts")
        recall = _audit(classes, counted, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"the audit of neighbours finds a recall of {recall:.4f}, below {RECALL}")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = members.join(smallest, "component").join(counted, "cid", "left").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    good = rows.where("good").join(per_class, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")))
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = good.select("id", "n_links", "component_id").unionByName(alone)
    return Result(every.select(
        F.col("id").alias(key), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), recall)

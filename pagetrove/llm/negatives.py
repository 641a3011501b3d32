"""Hard-negative mining over lists that a cluster of anchors shares.

Vectors are integers; a score is an inner product. Rows are sorted by label and nearest of some
centres and packed into blocks of one label, each with its mean direction, the largest angle to
it and the largest norm. A cluster is such a block of anchors. For a member u within angle r of its cluster's
direction c, no candidate v scores above |u| |v| cos(angle(v, c) - r), so one list of candidates, sorted by
|v| cos(angle(v, c) - r), serves all members: each walks it until the bound of what is left is below what it
still needs. Blocks have such a bound too, the list is sorted by it and each block within, and what no
member can need is never sent to a cluster.

A search runs twice, first among rows of the anchor's label for its positives, then among the others
for rows whose score lies in a window below each positive. Lists of more than LIST blocks are
walked in slices: the first slice gives scores that the members must beat in the others. Angles
carry SLACK for rounding; every score that counts is exact.

Rows take part if id and label are not null and the vector has no null or non-finite component. Of rows
with one id, the one with the smallest (label, vector) does. Vectors of different length do not meet;
one of length 0 or norm 0 scores 0. Ties go by smaller id. An empty table gives an empty result. Components
are 64-bit; a score outside 64 bits fails the job. Other columns are not read.
"""

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .shipping import map_arrow, ship

MEMBERS = 128  # anchors of a cluster
ROWS = 1_024  # candidates of a block
BLOCK_BYTES = 1 << 19  # of a block, at 8 bytes a component
CHUNK = 256  # entries of a list that members take at once
LIST = 256  # blocks of a slice of a list
SLACK = 1e-6

# Centres are fitted on a sample of this many rows; they decide the order of rows, not the result.
SAMPLE, CENTRES, STEPS = 2_048, 64, 4

# Bytes of cluster summaries that are broadcast at once.
SUMMARY_BYTES = 16_000_000

BLOCK = "dim int, label long, n int, ids binary, data binary, width int, centre binary, angle double, norm double"
LISTS = "cluster long, block long, bound double"
FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"
WINDOW = "struct<anchor_id: long, positive_id: long, positive_score: long, low: long, high: long>"
ANY = 1 << 62


def take_part(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v: rows that take part, components floor(scale * x)."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    numbers = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    clean = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    settled = settle(clean.select("vec_id", "label", numbers.alias("v")), "vectors")
    # Only ids are shuffled to find repeated ones; the vectors of those few are.
    repeated = settle(settled.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if repeated.isEmpty():
        return settled
    first = settled.join(repeated, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s"))
    return settled.join(repeated, "vec_id", "left_anti").unionByName(first.select("vec_id", "s.label", "s.v"))


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v, dtype=float), where=norm > 0)


def _angles(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles of the rows to a direction; a zero vector is at angle 0, its bound is 0 anyway."""
    units = _unit(v)
    return np.where(units.any(axis=1), np.arccos(np.clip(units @ centre, -1, 1)), 0.0)


def centres(rows: DataFrame) -> np.ndarray:
    """Directions fitted on the SAMPLE rows of smallest id hash, of the length that most of these have."""
    sample = [np.array(r["v"], float) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not sample:
        return np.empty((0, 0))
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    units = _unit(np.array([v for v in sample if len(v) == dim]).reshape(-1, dim))
    found = units[:CENTRES]
    for _ in range(STEPS):
        nearest = (units @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, units)
        found = np.where(sums.any(axis=1, keepdims=True), _unit(sums), found)
    return found


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat numbers, and where each row starts in them."""
    return column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()


def _with_cells(rows: DataFrame, fitted: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest centre, and ``dim``."""
    dim = fitted.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = _vectors(batch.column(2))
            lengths = np.diff(starts)
            cells = np.zeros(batch.num_rows, np.int32)
            own = np.flatnonzero(lengths == dim)
            if dim and own.size:
                cells[own] = (flat[starts[own][:, None] + np.arange(dim)] @ fitted.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells), pa.array(lengths.astype(np.int32))], names=[*batch.schema.names, "cell", "dim"])

    return map_arrow(rows.select("vec_id", "label", "v"), run, "vec_id long, label long, v array<long>, cell int, dim int")


def _pack(dim: int, label: int, ids: list[int], vectors: np.ndarray) -> tuple:
    """One block. Numbers are held in as few bytes as they need."""
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
    floats = vectors.astype(float)
    centre = _unit(_unit(floats).sum(axis=0))
    return (dim, label, len(ids), np.array(ids, "<i8").tobytes(), vectors.astype(f"<i{width}").tobytes(), width,
            centre.astype("<f8").tobytes(), float(_angles(floats, centre).max(initial=0)),
            float(np.linalg.norm(floats, axis=1).max(initial=0)))


def blocks(rows: DataFrame, fitted: np.ndarray, size: int, name: str) -> DataFrame:
    """Rows of one label and length, near ones together, in blocks of at most ``size`` and BLOCK_BYTES; settled."""
    order = ["dim", "label", "cell", F.xxhash64("vec_id"), "vec_id"]
    dealt = _with_cells(rows, fitted).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                flat, starts = _vectors(batch.column(3))
                places = zip(*(batch.column(i).to_pylist() for i in range(3)))
                for (dim, label, own), start, stop in zip(places, starts, starts[1:]):
                    yield dim, label, own, flat[start:stop]

        def packed() -> Iterator[tuple]:
            for (dim, label), members in groupby(each(), key=itemgetter(0, 1)):
                held: list[tuple] = []
                full = min(size, max(1, BLOCK_BYTES // (8 * max(1, dim))))
                for member in members:
                    held.append(member)
                    if len(held) == full:
                        yield _pack(dim, label, [m[2] for m in held], np.stack([m[3] for m in held]))
                        held = []
                if held:
                    yield _pack(dim, label, [m[2] for m in held], np.stack([m[3] for m in held]))

        for row in packed():
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(row, kinds)], names=[n for n, _ in kinds])

    kinds = [("dim", pa.int32()), ("label", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()),
             ("width", pa.int32()), ("centre", pa.binary()), ("angle", pa.float64()), ("norm", pa.float64())]
    made = map_arrow(dealt.select("dim", "label", "vec_id", "v"), run, BLOCK)
    return settle(made.withColumn("block", F.monotonically_increasing_id()), name)


def _bound(norm, angle, least: float = -1.0) -> np.ndarray:
    """Above |v| cos(angle), whatever rounding does. Where ``norm`` only is the largest, no cosine counts below 0."""
    return norm * np.maximum(np.cos(np.clip(angle - SLACK, 0, np.pi)), least) + SLACK * (norm + 1)


def lists(clusters: DataFrame, candidates: DataFrame, windows: DataFrame, same_label: bool) -> DataFrame:
    """(cluster, block, bound): per cluster the blocks that may hold what a member needs; settled.

    ``bound`` times a member's norm is at least every score with the block. Summaries of the clusters
    are broadcast in chunks of SUMMARY_BYTES.
    """
    spark = clusters.sparkSession
    ship(spark)
    needs = windows.groupBy("cluster").agg(F.min("need").alias("need"))
    summaries = settle(
        clusters.select(F.col("block").alias("cluster"), "dim", "label", "centre", "angle").join(needs, "cluster"), "summaries")
    total = summaries.agg(F.coalesce(F.sum(F.octet_length("centre") + 64), F.lit(0))).first()[0]
    chunks = max(1, -(-2 * total // SUMMARY_BYTES))
    made = None
    for chunk in range(chunks):
        part = summaries.where(F.pmod(F.xxhash64("cluster"), F.lit(chunks)) == chunk)
        by_dim: dict[int, list] = {}
        for r in part.collect():
            by_dim.setdefault(r["dim"], []).append(r)
        sent = spark.sparkContext.broadcast({
            dim: (np.array([r["cluster"] for r in rows]), np.array([r["label"] for r in rows]),
                  np.array([np.frombuffer(r["centre"], "<f8") for r in rows]).reshape(len(rows), dim),
                  np.array([r["angle"] for r in rows]), np.array([r["need"] for r in rows]))
            for dim, rows in by_dim.items()
        })

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, dim, label, centre, angle, norm in zip(*(c.to_pylist() for c in batch.columns)):
                    if dim not in sent.value:
                        continue
                    names, labels, middles, reaches, needs = sent.value[dim]
                    apart = np.arccos(np.clip(middles @ np.frombuffer(centre, "<f8"), -1, 1))
                    # A block or cluster of zero vectors has no direction: nothing is known of its angle.
                    apart = np.where(middles.any(axis=1) & any(np.frombuffer(centre, "<f8")), apart, 0.0)
                    bounds = _bound(norm, apart - angle - reaches, 0.0)
                    kept = np.flatnonzero(((labels == label) == same_label) & (bounds >= needs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[kept], pa.int64()), pa.array([block] * kept.size, pa.int64()), pa.array(bounds[kept])],
                        names=["cluster", "block", "bound"])

        found = map_arrow(candidates.select("block", "dim", "label", "centre", "angle", "norm"), run, LISTS)
        made = found if made is None else made.unionByName(found)
    return settle(made, "lists")


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while these hold them, else in Python's integers."""
    most = int(np.abs(a.astype(float)).max(initial=0) + 1) * int(np.abs(b.astype(float)).max(initial=0) + 1) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return exact.astype(np.int64)


class _Block(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray


def _unpack(ids: bytes, data: bytes, width: int, dim: int) -> _Block:
    own = np.frombuffer(ids, "<i8")
    vectors = np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(own.size, dim)
    return _Block(own, vectors, np.linalg.norm(vectors.astype(float), axis=1))


class Walk:
    """The members of one cluster on their way along its list."""

    def __init__(self, members: _Block, centre: np.ndarray, angle: float, windows: list[dict], keep: int):
        self.members, self.centre, self.angle, self.keep = members, centre, angle, keep
        self.windows = windows
        place = {own: i for i, own in enumerate(members.ids.tolist())}
        self.member = np.array([place[w["anchor_id"]] for w in windows], int)
        self.need = np.array([w["low"] for w in windows], np.int64)
        self.high = np.array([w["high"] for w in windows], np.int64)
        self.pool = np.empty((3, 0), np.int64)  # window, score, id
        self.done = False
        self.read = 0  # scores computed, for tests

    def _open(self, bound: float) -> np.ndarray:
        """Windows that something below ``bound`` may still get into."""
        norms = self.members.norms[self.member]
        return np.flatnonzero(norms * bound + SLACK * (1 + norms) >= self.need)

    def take(self, block: _Block, bound: float) -> None:
        """A block of the list; ``bound`` falls from block to block."""
        if self.done or not self._open(bound).size:
            self.done = True
            return
        bounds = _bound(block.norms, _angles(block.vectors.astype(float), self.centre) - self.angle)
        if not self.centre.any():
            bounds = _bound(block.norms, np.zeros(block.norms.size))
        order = np.argsort(-bounds, kind="stable")
        for at in range(0, order.size, CHUNK):
            chunk = order[at : at + CHUNK]
            here = self._open(bounds[chunk[0]])
            if not here.size:
                break
            users, row = np.unique(self.member[here], return_inverse=True)
            scores = _scores(self.members.vectors[users], block.vectors[chunk])
            self.read += scores.size
            mine = scores[row]
            fits = (mine >= self.need[here][:, None]) & (mine <= self.high[here][:, None])
            fits &= self.members.ids[self.member[here]][:, None] != block.ids[chunk][None, :]
            w, c = np.nonzero(fits)
            if w.size:
                self._merge(np.stack([here[w], mine[w, c], block.ids[chunk][c]]))

    def _merge(self, new: np.ndarray) -> None:
        pool = np.concatenate([self.pool, new], axis=1)
        pool = pool[:, np.lexsort((pool[2], -pool[1], pool[0]))]
        window = pool[0]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        rank = np.arange(window.size) - np.repeat(first, np.diff(np.r_[first, window.size]))
        last = rank == self.keep - 1
        self.need[window[last]] = pool[1, last]
        self.pool = pool[:, rank < self.keep]

    def found(self) -> Iterator[tuple]:
        for window, score, own in zip(*self.pool.tolist()):
            w = self.windows[window]
            yield w["anchor_id"], w["positive_id"], w["positive_score"], own, score


def _walk(parts: DataFrame, clusters: DataFrame, candidates: DataFrame, windows: DataFrame, keep: int) -> DataFrame:
    """``parts`` (cluster, slice, block, bound): each slice of a list is one stream, the cluster ahead of its blocks."""
    spark = parts.sparkSession
    asked = windows.groupBy("cluster").agg(F.collect_list(F.struct(
        "anchor_id", "positive_id", "positive_score", "low", "high")).alias("windows"))  # at most MEMBERS x positives
    payload = ("dim", "ids", "data", "width", "centre", "angle")
    heads = parts.select("cluster", "slice").distinct().join(
        clusters.select(F.col("block").alias("cluster"), *payload), "cluster").join(asked, "cluster")
    entries = parts.join(candidates.select("block", *payload), "block")
    order = ("cluster", "slice", "bound", *payload, "windows")
    stream = heads.withColumn("bound", F.lit(float("inf"))).select(*order).unionByName(
        entries.withColumn("windows", F.lit(None).cast(f"array<{WINDOW}>")).select(*order))
    stream = stream.repartition("cluster", "slice").sortWithinPartitions("cluster", "slice", F.desc("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in range(0, batch.num_rows, 8)
                for row in zip(*(c.to_pylist() for c in batch.slice(part, 8).columns)))
        for _, group in groupby(rows, key=itemgetter(0, 1)):
            walk = None
            for _, _, bound, dim, ids, data, width, centre, angle, asked in group:
                if walk is None:
                    walk = Walk(_unpack(ids, data, width, dim), np.frombuffer(centre, "<f8"), angle, asked, keep)
                elif not walk.done:
                    walk.take(_unpack(ids, data, width, dim), bound)
            columns = list(zip(*walk.found())) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    ship(spark)
    return map_arrow(stream, run, FOUND)


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The best of all slices of each window; a window has at most ``keep`` rows from each."""
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _needs(windows: DataFrame) -> DataFrame:
    """``need``: what |v| cos must reach for a window; a member of norm 0 scores 0."""
    low, norm = F.col("low").cast("double"), F.col("norm")
    return windows.withColumn("need", F.when(low <= 0, F.lit(float("-inf"))).when(norm > 0, low / norm).otherwise(F.lit(float("inf")))
                              - F.lit(2 * SLACK) * (1 + F.lit(1) / F.greatest(norm, F.lit(1.0))))


def search(clusters: DataFrame, candidates: DataFrame, windows: DataFrame, same_label: bool, keep: int) -> DataFrame:
    """Per window the first ``keep`` rows by score and id, as FOUND and rank; settled.

    ``windows``: cluster, norm, anchor_id, positive_id, positive_score, low, high.
    """
    windows = _needs(windows)
    found = lists(clusters, candidates, windows, same_label)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), "block")) - 1
    sliced = settle(found.withColumn("slice", F.floor(place / LIST).cast("int")), "sliced-lists")
    first = _walk(sliced.where("slice = 0"), clusters, candidates, windows, keep)
    if sliced.where("slice > 0").isEmpty():
        return settle(_first(first, keep), "found")
    first = settle(first, "first-slice")
    full = first.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    same = windows["anchor_id"].eqNullSafe(full["anchor_id"]) & windows["positive_id"].eqNullSafe(full["positive_id"])
    raised = windows.join(full, same, "left").select(
        *[windows[c] for c in windows.columns if c not in ("low", "need")],
        F.when(F.col("n") == keep, F.greatest(windows["low"], "least")).otherwise(windows["low"]).alias("low"))
    raised = settle(_needs(raised), "raised-windows")
    least = raised.groupBy("cluster").agg(F.min("need").alias("need"))
    rest = sliced.where("slice > 0").join(least, "cluster").where(F.col("bound") >= F.col("need")).drop("need")
    return settle(_first(first.unionByName(_walk(rest, clusters, candidates, raised, keep)), keep), "found")


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` picks the anchors by vec_id. A negative's score is ``low`` to ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    vectors = take_part(rows, scale)
    fitted = centres(vectors)
    candidates = blocks(vectors, fitted, ROWS, "candidates")
    clusters = blocks(vectors.where(anchor), fitted, MEMBERS, "clusters")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ids = _members(clusters)
    anchors = settle(vectors.where(anchor).select(F.col("vec_id").alias("anchor_id"), norm.alias("norm")).join(ids, "anchor_id"), "anchors")
    nothing = F.lit(None).cast("long")
    every = anchors.select(
        "*", nothing.alias("positive_id"), nothing.alias("positive_score"), F.lit(-ANY).alias("low"), F.lit(ANY).alias("high"))
    near = search(clusters, candidates, every, True, positives)
    # 100 * score from low * positive to high * positive, in whole numbers: (x + 99) div 100 rounds up from zero on.
    score, wide = F.col("score"), "cast(score AS decimal(19))"
    below = near.where(score >= 0).select(
        "anchor_id", F.col("found_id").alias("positive_id"), score.alias("positive_score"),
        F.expr(f"({low} * {wide} + 99) div 100").alias("low"), F.expr(f"({high} * {wide}) div 100").alias("high"))
    found = search(clusters, candidates, settle(below.join(anchors, "anchor_id"), "windows"), False, negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _members(clusters: DataFrame) -> DataFrame:
    """(anchor_id, cluster) of all clusters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, ids in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.full(own.size, cluster))], names=["anchor_id", "cluster"])

    return map_arrow(clusters.select("block", "ids"), run, "anchor_id long, cluster long")

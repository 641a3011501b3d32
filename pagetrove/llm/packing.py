"""Packing into sequences by matching large items, with best fit for the rest.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers. Two
pieces above a third of the capacity, and never three, share a sequence: the longest is matched with
the longest that still fits. Shorter pieces, longest first, go to the smallest gap that holds
them, as often as it holds them; what fits nowhere opens new sequences. Equal sequences are planned as one
group, so the plan does not grow with the number of documents.

Pieces take their places by rank among those of their length. Ranks are counted in chunks of
the ids' hash, so no task numbers all pieces of a frequent length. The token ids go along.

Ids are those of the tokenizer file as it is loaded: texts are cut at its added tokens first, the rest is
merged by rank. Between the steps an id takes two bytes if all ids fit.

A null text is one end token. Long documents are cut into full pieces, the first piece takes the
remainder. Repeated rows are pieces of their own; a null id is an id. An empty table gives an
empty result.
"""

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shipping import map_arrow, ship
from ..session import settle

CHUNK_ROWS = 1_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
SPANS = "length long, low long, high long, sequence long, per long, place long"


class Encoder:
    """Ids of whole texts by a vocabulary in the order of its merges, and added tokens with their ids."""

    def __init__(self, vocabulary: list[bytes], added: dict[str, int], pattern: str):
        import tiktoken

        self.vocabulary, self.added, self.pattern = vocabulary, added, pattern
        ranks = {entry: rank for rank, entry in enumerate(vocabulary)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True)) or r"(?!)").split
        self.slow: bpe.Codec | None = None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its matcher gives up on very long runs of white space
            return self._encode_slowly(text)

    def _encode_slowly(self, text: str) -> np.ndarray:
        if self.slow is None:
            self.slow = bpe.codec(bpe.serialise(self.vocabulary), self.pattern)
        parts = [p for p in self.cut(text) if p]
        ids = [[self.added[p]] if p in self.added else self.slow.encode_batch([p])[0] for p in parts]
        return np.array(sum(ids, []), np.uint32)


_encoders: dict[tuple, Encoder] = {}


def _encoder(vocabulary: list[bytes], added: dict[str, int], pattern: str) -> Encoder:
    """One per worker process, kept from task to task."""
    key = (len(vocabulary), hash(tuple(vocabulary)), tuple(added.items()), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, added, pattern)
    return _encoders[key]


def pieces_of(
    docs: DataFrame, vocabulary: list[bytes], added: dict[str, int], pattern: str, capacity: int, end: int,
    key: str = "doc_id",
) -> DataFrame:
    """Pieces of all documents: ids of the whole text and the end token, cut to the capacity.

    ``ids`` holds ``width`` bytes an id, lowest first.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((vocabulary, added))
    kind = f"<u{id_width(vocabulary, added, end)}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*sent.value, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for own, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.append(encoder.encode(text or ""), end).astype(kind)
                start, stop = 0, (len(tokens) - 1) % capacity + 1
                for piece in range(-(-len(tokens) // capacity)):
                    rows.append((own, piece, start, stop - start, tokens[start:stop].tobytes()))
                    start, stop = stop, stop + capacity
            fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                      ("length", pa.int64()), ("ids", pa.binary())]
            columns = zip(*rows) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields]
            )

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), "text"), cut, PIECES)


def id_width(vocabulary: list[bytes], added: dict[str, int], end: int) -> int:
    return 2 if max(len(vocabulary) - 1, end, *added.values()) < 1 << 16 else 4


def widen(placed: DataFrame) -> DataFrame:
    """``ids`` of two bytes each as four."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    at = placed.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.frombuffer(ids, "<u2").astype("<u4").tobytes() for ids in batch.column(at).to_pylist()]
            yield batch.set_column(at, "ids", pa.array(wide, pa.binary()))

    return map_arrow(placed, run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Spans (length, low, high, sequence, per, place).

    Pieces of this length ranked low to high - 1 go, ``per`` to a sequence, into the sequences
    from ``sequence`` on, the first of each at ``place``.
    """
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    spans: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups (first sequence, number of sequences)
    order: list[int] = []  # gaps in use, ascending
    sequences = 0

    def take(length: int, n: int, sequence: int, per: int, place: int) -> None:
        spans.append((length, used[length], used[length] + n, sequence, per, place))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        if at < 0:
            n = left[longest]
            take(longest, n, sequences, 1, 0)
            gap = capacity - longest
        else:
            partner = large[at]
            n = left[longest] // 2 if partner == longest else min(left[longest], left[partner])
            if partner == longest and not n:  # a single one is left: match it with a shorter one
                partner = large[at - 1] if at else None
                n = 1
            take(longest, n, sequences, 1, 0)
            if partner is not None:
                take(partner, n, sequences, 1, longest)
            gap = capacity - longest - (partner or 0)
        leave(gap, sequences, n)
        sequences += n
        large = [length for length in large if left[length]]

    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                number = max(1, left[length] // per)
                leave(capacity, sequences, number)
                sequences += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = min(gap // length, left[length])
            filled = min(number, left[length] // per)
            take(length, filled * per, first, per, capacity - gap)
            leave(gap - per * length, first, filled)
            leave(gap, first + filled, number - filled)
    return spans


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = settle(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    spans = plan(counts, capacity)
    chunks = 1 + max(counts.values(), default=0) // CHUNK_ROWS
    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    own = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece")
    ranked = chunked.withColumn("_local", F.row_number().over(own) - 1)
    earlier = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy("length", "_chunk").count()
    first = sizes.select("length", "_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
    ranked = ranked.join(first, ["length", "_chunk"]) if chunks > 1 else ranked.withColumn("_first", F.lit(0))
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_local"))
    # At most a few spans per length and gap: bounded by the capacity, not by the documents.
    table = F.broadcast(spark.createDataFrame(spans, SPANS).withColumnRenamed("length", "_length"))
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    step = F.col("_rank") - F.col("low")
    return ranked.join(table, here).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + step % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """All documents, by the vocabulary of a tokenizer file, in sequences of at most ``capacity`` ids.

    One row per piece with its ``ids``, their checksum, its sequence and its offset there: the ids
    of a sequence are those of its pieces, by offset.
    """
    vocabulary, added = bpe.read_json(path), bpe.read_added(path)
    placed = place(pieces_of(docs, vocabulary, added, pattern, capacity, end), capacity)
    if id_width(vocabulary, added, end) == 2:
        placed = widen(placed)
    return placed.withColumn("ids_crc32", F.crc32("ids"))

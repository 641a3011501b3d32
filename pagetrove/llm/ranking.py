"""Ranked lexical search by scanning whole texts with an Aho-Corasick automaton.

The distinct terms of all items form one automaton that executors get by broadcast. Each term is
guarded by a space on both sides, and each text is folded so that its terms stand between single
spaces, so every hit of the automaton is one occurrence of a whole term. There is no index of the
documents: a scan yields per document its number of terms and the frequencies of the item terms in it,
written once. Document frequencies are counted from that table, and a second pass over it turns hits
into scores, for which each term's outputs lead to the items that hold it.

Every task keeps the best ``top`` documents per item, so scores of all pairs never leave a task; the
lists of tasks meet in two steps, by item and bucket, then by item. Items beyond GROUP_BYTES of
terms are searched in groups, one automaton and one scan each.

A null or empty text has no terms; it counts for nothing and is never found. An item without terms
finds nothing. Rows that share an item_id are one item with the terms of all its texts, a null
item_id is an id like others. Repeated documents are found each by itself; equal scores go by
ascending doc_id, null ids last. Empty tables give an empty result. Other columns are not read.
"""

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .shipping import map_arrow, ship

# Bounds of one broadcast: bytes of terms, each with a flat charge, and number of items.
GROUP_BYTES = 16_000_000
GROUP_ITEMS = 20_000
TERM_CHARGE = 16

# Scores held at once, and buckets of the first merge.
CELLS = 2_000_000
BUCKETS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The same by byte: in UTF-8 every byte of a character outside ASCII is 128 or more.
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))

HITS = "doc_id long, n long, terms array<int>, counts array<long>"
FOUND = "_item int, score long, doc_id long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, as folded UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _spaced(terms: list[bytes]) -> str:
    """Terms between single spaces; one character a byte, as the automaton's keys are."""
    return f" {b' '.join(terms).decode('latin-1')} "


def build(terms: list[bytes]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        automaton.add_word(_spaced([term]), place)
    automaton.make_automaton()
    return automaton


def count_terms(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each term of the automaton occurs."""
    terms = terms_of(text)
    return len(terms), Counter(map(itemgetter(1), automaton.iter(_spaced(terms)))) if terms else Counter()


def scan(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Per document its number of terms and the frequencies of those listed, by place in the list."""
    spark = docs.sparkSession
    ship(spark)
    listed = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(listed.value)
        for batch in batches:
            sizes, ends, places, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                n, found = count_terms(automaton, text)
                sizes.append(n)
                places += found.keys()
                counts += found.values()
                ends.append(len(places))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                names=["doc_id", "n", "terms", "counts"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, HITS)


class Outputs(NamedTuple):
    """Items of each term: those of term t are ``items[starts[t]:starts[t + 1]]``."""

    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    n_items: int
    n_docs: int
    n_terms: int


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The best documents per item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.floor = np.ones(n_items, np.int64)  # scores below cannot get in
        self.rows = np.empty((4, 0), np.int64)  # item, score, null id, id
        self.limit = 2 * top * n_items

    def add(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate([self.rows, rows], axis=1)
        if self.rows.shape[1] > self.limit:
            self.cut()

    def cut(self) -> None:
        item, score, null, doc = self.rows
        order = np.lexsort((doc, null, -score, item))
        self.rows = self.rows[:, order]
        item = self.rows[0]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if item.size else np.empty(0, int)
        rank = np.arange(item.size) - np.repeat(first, np.diff(np.r_[first, item.size]))
        last = rank == self.top - 1
        self.floor[item[last]] = self.rows[1, last]
        self.rows = self.rows[:, rank < self.top]


def _scores(out: Outputs, n: list[int], ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Documents x items, in 64-bit integers."""
    m = np.array([50 + 50 * x * out.n_docs // out.n_terms for x in n], np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(ends))
    gain = out.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[doc]))
    width = out.starts[terms + 1] - out.starts[terms]
    total = int(width.sum())
    # Place of each (hit, item) in the outputs: runs of consecutive numbers, one per hit.
    place = np.arange(total) + np.repeat(out.starts[terms] - (np.cumsum(width) - width), width)
    scores = np.zeros(len(n) * out.n_items, np.int64)
    np.add.at(scores, np.repeat(doc * out.n_items, width) + out.items[place], np.repeat(gain, width))
    return scores.reshape(len(n), out.n_items)


def _best(hits: DataFrame, outputs: Outputs, top: int) -> DataFrame:
    """Best documents per item of each task."""
    sent = hits.sparkSession.sparkContext.broadcast(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sent.value
        best = _Best(out.n_items, top)
        rows = max(1, CELLS // out.n_items)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids, n, terms, counts = batch.columns
                # flatten() follows the slice, offsets do not start at zero there.
                ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
                scores = _scores(out, n.to_pylist(), ends, terms.flatten().to_numpy(), counts.flatten().to_numpy())
                doc, item = np.nonzero(scores >= best.floor)
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                plain = ids.fill_null(0).to_numpy()
                best.add(np.stack([item, scores[doc, item], null[doc], plain[doc]]))
        best.cut()
        item, score, null, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64(), mask=null == 1)],
            names=["_item", "score", "doc_id"])

    return map_arrow(hits.where(F.size("terms") > 0), run, FOUND)


def _groups(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, term) rows with ``_group``, so that a group's terms are safe to broadcast.

    A group exceeds the bounds only by a single item that does.
    """
    sizes = settle(
        pairs.groupBy("item_id").agg(F.sum(F.octet_length("term") + TERM_CHARGE).alias("bytes")), "item-sizes")
    total, items = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    number = max(1, math.ceil(total / GROUP_BYTES), math.ceil(items / GROUP_ITEMS))

    def group(n):
        return F.pmod(F.xxhash64("item_id"), F.lit(n))

    while number > 1:
        loads = sizes.groupBy(group(number).alias("g")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        crowded = loads.where((F.col("n") > 1) & ((F.col("b") > GROUP_BYTES) | (F.col("n") > GROUP_ITEMS)))
        if crowded.isEmpty():
            break
        number *= 2
    return pairs.withColumn("_group", group(number)), number


def rank(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    folded = F.translate("text", UPPER, LOWER)
    pairs = settle(
        items.select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).distinct(),
        "item-terms")
    grouped, number = _groups(pairs)
    found, totals = [], None
    for g in range(number):
        rows = grouped.where(F.col("_group") == g).select("item_id", "term").collect()
        if not rows:
            continue
        ids = list(dict.fromkeys(r["item_id"] for r in rows))
        terms = sorted({r["term"].encode() for r in rows})
        hits = settle(scan(docs, terms), "term-hits")
        if totals is None:
            totals = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        if not n_terms:
            break
        # One number per term of the group, bounded as the group is.
        df = dict(hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        place, item = {t: i for i, t in enumerate(terms)}, {v: i for i, v in enumerate(ids)}
        links = sorted((place[r["term"].encode()], item[r["item_id"]]) for r in rows)
        starts = np.searchsorted([t for t, _ in links], np.arange(len(terms) + 1))
        outputs = Outputs(
            starts, np.array([i for _, i in links], np.int64),
            np.array([weight(n_docs, df.get(i, 0)) for i in range(len(terms))], np.int64), len(ids), n_docs, n_terms)
        names = spark.createDataFrame([(i, v) for v, i in item.items()], f"_item int, item_id {id_type}")
        best = _merged(_best(hits, outputs, top), top)
        found.append(best.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks, first in buckets of tasks, so no task gathers the lists of all others."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    bucketed = found.withColumn("_bucket", F.spark_partition_id() % BUCKETS)
    for keys in (["_item", "_bucket"], ["_item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        bucketed = bucketed.withColumn("rank", place).where(F.col("rank") <= top)
    return bucketed

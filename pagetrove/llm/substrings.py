"""Repeated passages by sharded Aho-Corasick automata over words.

A window is WINDOW consecutive words. Every window selects one phrase of PHRASE words, the one of
least hash, so equal windows select equal phrases wherever they stand.

1. Scan: the selected phrases of each document, by hash, each with the hash of all words its
   windows span. A phrase that one document holds alone is dropped. A phrase with one surrounding
   everywhere belongs, with its windows, to its smallest document.
2. Confirm: windows around the other recurring phrases are counted one by one; a window of two
   or more documents belongs to the smallest. What a document owns, joined, are its passages.
3. Compile: passages are dealt to shards by the smallest document that has the phrase, so copies of one
   text meet in one shard. A shard's automaton holds the phrases of its passages.
4. Stream: the parts of every document that hold recurring phrases pass through the automaton of their
   shard. Around each located phrase the windows are looked up among those of the passages, and
   a run of them that a smaller document has, word by word, is an occurrence.

Hashes only choose what is compared; what is removed has been compared word by word. Groups are
counted with partial sums. Every phrase of a document goes to one shard, so what is streamed grows
with the input; shards with much to stream are split into cells, each with a copy of the
automaton. A document's words are the largest thing a task holds at once.

Null and empty texts have no words. Documents with a null id keep all words and own none. Rows of one
id do not count against each other; equal rows get equal results. An empty table gives an empty result.
"""

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, settle
from .shipping import map_arrow

WINDOW = 50
PHRASE = 8
SHARD_WORDS = 250_000
CELL_WORDS = 20_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD_SPAN = re.compile(rb"[^\x20\x09-\x0d]+")


class Sequence:
    """Words of one document with the hashes of their windows and selected phrases."""

    def __init__(self, words: list[bytes]):
        self.words = words
        n = len(words)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.windows = max(0, n - WINDOW + 1)
        if not self.windows:
            return
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(self.hashes * powers)]
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE, np.uint64)])
        starts = np.arange(n - PHRASE + 1)
        self.phrases = self.spans(starts, starts + PHRASE)
        view = np.lib.stride_tricks.sliding_window_view(self.phrases, WINDOW - PHRASE + 1)
        self.selected = view.argmin(axis=1) + np.arange(self.windows)
        self.low = np.r_[0, np.flatnonzero(np.diff(self.selected)) + 1]
        self.high = np.r_[self.low[1:], self.windows] - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to before its end."""
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + ends.astype(np.uint64) - starts.astype(np.uint64)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))

    def keys(self) -> np.ndarray:
        """Phrase hash of each group of windows with one selected phrase."""
        return self.phrases[self.selected[self.low]].view(np.int64) if self.windows else np.empty(0, np.int64)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _mapper(function, fields: list[tuple[str, pa.DataType]]):
    """Arrow mapper whose function makes rows of the values of one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                rows += function(*values)
            yield _batch(rows, fields)

    return run


KEY = [("doc_id", pa.int64()), ("h", pa.int64())]
KEY_DDL = "doc_id long, h long"


def _scan(doc_id, h, text):
    words = _split(text)
    digest = hashlib.sha256(b" ".join(words)).hexdigest()
    sequence = Sequence(words)
    keys = sequence.keys()
    around = sequence.spans(sequence.low, sequence.high + WINDOW).view(np.int64) if len(keys) else keys
    return [(doc_id, h, len(words), digest, keys, around)]


def _mixed_windows(doc_id, h, text, keys, owners):
    """Windows around phrases without a single surrounding."""
    mixed = np.array([k for k, owner in zip(keys, owners) if owner is None], np.int64)
    sequence = Sequence(_split(text))
    own = sequence.phrases[sequence.selected].view(np.int64)
    at = np.flatnonzero(np.isin(own, mixed))
    hashes = sequence.spans(at, at + WINDOW).view(np.int64)
    return [(doc_id, h, k, w, p) for k, w, p in zip(own[at].tolist(), hashes.tolist(), at.tolist())]


def _by_least(words: list[bytes], groups: dict[int, list[tuple[int, int]]]):
    """Merged spans of words by the smallest document of their phrases."""
    for least, spans in groups.items():
        for low, high in _merge(spans):
            yield least, low, high, b" ".join(words[low:high]).decode()


def _passages(doc_id, h, text, keys, owners, leasts, places):
    """Word spans that the document owns."""
    whole = {k for k, owner in zip(keys, owners) if owner == doc_id}
    least = dict(zip(keys, leasts))
    words = _split(text)
    sequence = Sequence(words)
    groups: dict[int, list[tuple[int, int]]] = {}
    for p in places or ():
        key = int(sequence.phrases[sequence.selected[p]].view(np.int64))
        groups.setdefault(least[key], []).append((p, p + WINDOW))
    for key, low, high in zip(sequence.keys().tolist(), sequence.low.tolist(), sequence.high.tolist()):
        if key in whole:
            groups.setdefault(least[key], []).append((low, high + WINDOW))
    return [(least, doc_id, high - low, part) for least, low, high, part in _by_least(words, groups)]


def _segments(doc_id, h, text, keys, leasts):
    """Parts of the document around the phrases that a smaller document has."""
    least = dict(zip(keys, leasts))
    words = _split(text)
    sequence = Sequence(words)
    groups: dict[int, list[tuple[int, int]]] = {}
    for key, low, high in zip(sequence.keys().tolist(), sequence.low.tolist(), sequence.high.tolist()):
        if key in least:
            groups.setdefault(least[key], []).append((low, high + WINDOW))
    return [(least, doc_id, h, low, high - low, part) for least, low, high, part in _by_least(words, groups)]


class Automaton:
    """Phrases and windows of the passages of one cell; locates what smaller documents have."""

    def __init__(self) -> None:
        self.passages: list[list[bytes]] = []
        self.windows: dict[int, tuple[int, int, int]] = {}  # hash -> smallest owner, passage, place
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.compiled = False

    def add(self, owner: int, text: str) -> None:
        sequence = Sequence(_split(text))
        letters = _letters(sequence)
        for at in np.unique(sequence.selected).tolist():
            self.machine.add_word(letters[at : at + PHRASE])
        starts = np.arange(sequence.windows)
        number = len(self.passages)
        for at, key in enumerate(sequence.spans(starts, starts + WINDOW).tolist()):
            if key not in self.windows or owner < self.windows[key][0]:
                self.windows[key] = (owner, number, at)
        self.passages.append(sequence.words)

    def locate(self, doc_id: int, text: str) -> list[tuple[int, int]]:
        """Merged word spans of ``text`` that stand in passages of smaller documents."""
        if not self.passages:
            return []
        if not self.compiled:
            self.machine.make_automaton()
            self.compiled = True
        sequence = Sequence(_split(text))
        ends = [end for end, _ in self.machine.iter(_letters(sequence))]
        hit = np.zeros(len(sequence.words), bool)
        hit[np.array(ends, np.int64) - (PHRASE - 1)] = True
        at = np.flatnonzero(hit[sequence.selected])
        found = []
        run = None  # first window, next window, passage, place in the passage less that in the text
        for p, key in zip(at.tolist(), sequence.spans(at, at + WINDOW).tolist()):
            entry = self.windows.get(key)
            if entry is None or entry[0] >= doc_id:
                continue
            if run is not None and run[1] == p and run[2] == entry[1] and run[3] == entry[2] - p:
                run = (run[0], p + 1, *run[2:])
                continue
            self._confirm(sequence.words, run, found)
            run = (p, p + 1, entry[1], entry[2] - p)
        self._confirm(sequence.words, run, found)
        return _merge(found)

    def _confirm(self, words: list[bytes], run, found: list[tuple[int, int]]) -> None:
        if run is not None:
            low, high = run[0], run[1] - 1 + WINDOW
            if words[low:high] == self.passages[run[2]][low + run[3] : high + run[3]]:
                found.append((low, high))


def _letters(sequence: Sequence) -> tuple[int, ...]:
    return tuple((sequence.hashes & np.uint64(0x7FFFFFFF)).tolist())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell, passages (null start) before parts of documents."""
    cell, automaton = None, Automaton()
    for batch in batches:
        rows = []
        for shard, part, doc_id, h, start, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (shard, part) != cell:
                cell, automaton = (shard, part), Automaton()
            if start is None:
                automaton.add(doc_id, text)
            else:
                rows += [(doc_id, h, start + a, start + b) for a, b in automaton.locate(doc_id, text)]
        yield _batch(rows, [*KEY, ("low", pa.int64()), ("high", pa.int64())])


def _kept(doc_id, h, text, lows, highs):
    """What is left: the kept words' digest, and the text without the removed words."""
    data = (text or "").encode()
    spans = _merge(list(zip(lows, highs)))
    gone = np.zeros(sum(1 for _ in WORD_SPAN.finditer(data)), bool)
    for low, high in spans:
        gone[low:high] = True
    places = [m.span() for m in WORD_SPAN.finditer(data)]
    kept = [data[a:b] for (a, b), out in zip(places, gone) if not out]
    pieces, end = [], 0
    for low, high in spans:
        pieces.append(data[end : places[low][0]])
        end = places[high - 1][1]
    pieces.append(data[end:])
    return [(doc_id, h, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b"".join(pieces).decode())]


class Found:
    """Result of ``find``: ``scan`` has a row per row of the input, ``changed`` one per text that loses words."""

    def __init__(self, scan: DataFrame, changed: DataFrame):
        self.scan, self.changed = scan, changed


def _aside(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` in the shared folder, bucketed by document, so that later joins do not move its texts.

    Buckets need a table; its name is returned, to be dropped when nothing reads it any more.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, "doc_id", "h").option("path", scratch_path(spark, name)).option(
        "compression", "zstd").saveAsTable(table)
    return spark.table(table), table


def find(docs: DataFrame, key: str, text: str, wanted_columns: list[str]) -> Found:
    """``changed`` has doc_id, h and the wanted ones of n_removed, kept_sha256 and kept_text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    longs = pa.list_(pa.int64())
    scan = settle(map_arrow(rows, _mapper(_scan, [
        *KEY, ("n_words", pa.int64()), ("words_sha256", pa.string()), ("keys", longs), ("around", longs)
    ]), KEY_DDL + ", n_words long, words_sha256 string, keys array<long>, around array<long>"), "substring-scan")

    flat = scan.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "h", F.explode(F.arrays_zip("keys", "around")).alias("k")
    ).select("doc_id", "h", F.col("k.keys").alias("key"), "k.around")
    one = F.col("one") == F.col("other")
    recurring = settle(flat.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.min("around").alias("one"), F.max("around").alias("other"),
    ).where("least < most").select("key", "least", F.when(one, F.col("least")).alias("owner")), "recurring-phrases")
    hits = flat.select("doc_id", "h", "key").join(recurring, "key").groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("key", "owner", "least")).alias("hits")
    ).select("doc_id", "h", *[F.col(f"hits.{c}").alias(f"{c}s") for c in ("key", "owner", "least")])
    texts, table = _aside(rows.join(hits.hint("shuffle_hash"), ["doc_id", "h"]), "affected")

    mixed = texts.where(F.exists("owners", lambda o: o.isNull()))
    windows = map_arrow(
        mixed.select("doc_id", "h", "text", "keys", "owners"),
        _mapper(_mixed_windows, [*KEY, ("key", pa.int64()), ("window", pa.int64()), ("place", pa.int32())]),
        KEY_DDL + ", key long, window long, place int",
    )
    owned = settle(windows.groupBy("key", "window").agg(
        F.min(F.struct("doc_id", "h", "place")).alias("first"), F.max("doc_id").alias("most")
    ).where("first.doc_id < most").select("key", "first.*"), "owned-windows")
    places = owned.groupBy("doc_id", "h").agg(F.collect_list("place").alias("places"))
    own = texts.join(places, ["doc_id", "h"], "left").where(
        F.col("places").isNotNull() | F.exists("owners", lambda o: F.coalesce(o == F.col("doc_id"), F.lit(False))))
    passages = settle(map_arrow(
        own.select("doc_id", "h", "text", "keys", "owners", "leasts", "places"),
        _mapper(_passages, [("least", pa.int64()), ("owner", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())]),
        "least long, owner long, n_words long, text string",
    ), "passages")

    # Phrases that recur while none of their windows does are not streamed.
    flat_hits = texts.select("doc_id", "h", F.explode(F.arrays_zip("keys", "owners", "leasts")).alias("k")).select(
        "doc_id", "h", F.col("k.keys").alias("key"), F.col("k.owners").alias("owner"), F.col("k.leasts").alias("least")
    ).where(F.col("least") < F.col("doc_id"))
    # Written, so that a frequent phrase can be split in the join.
    confirmed = settle(owned.select("key").distinct(), "confirmed-phrases")
    sure = flat_hits.where(F.col("owner").isNotNull()).unionByName(
        flat_hits.where(F.col("owner").isNull()).join(confirmed, "key", "left_semi"))
    wanted = sure.groupBy("doc_id", "h").agg(F.collect_set(F.struct("key", "least")).alias("to")).select(
        "doc_id", "h", F.col("to.key").alias("to_keys"), F.col("to.least").alias("to_leasts"))
    segments = settle(map_arrow(
        texts.join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "to_keys", "to_leasts"),
        _mapper(_segments, [("least", pa.int64()), *KEY, ("start", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())]),
        "least long, doc_id long, h long, start long, n_words long, text string",
    ), "segments")

    total = passages.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("least"), F.lit(max(parts, -(-total // SHARD_WORDS)))).cast("int")
    books, pages = passages.withColumn("shard", shard), segments.withColumn("shard", shard)
    # A cell streams at least as many words as its automaton holds, so copies cost little.
    held = books.groupBy("shard").agg(F.sum("n_words").alias("held"))
    load = pages.groupBy("shard").agg(F.sum("n_words").alias("load"))
    cells = settle(load.join(held, "shard").select("shard", F.ceil(
        F.col("load") / F.greatest(F.lit(CELL_WORDS), F.col("held"))).cast("int").alias("cells")), "cells")
    copies = books.join(cells, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"),
        F.col("owner").alias("doc_id"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("start"), "text")
    streamed = pages.join(cells, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "h", "start"), F.col("cells")).cast("int").alias("cell"),
        "doc_id", "h", "start", "text")
    ready = copies.unionByName(streamed).repartition(max(parts, -(-total // SHARD_WORDS)), "shard", "cell"
    ).sortWithinPartitions("shard", "cell", F.col("start").asc_nulls_first())
    removed = map_arrow(ready, _stream, KEY_DDL + ", low long, high long")
    spans = removed.groupBy("doc_id", "h").agg(F.collect_set(F.struct("low", "high")).alias("s")).select(
        "doc_id", "h", F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))
    changed = map_arrow(
        texts.join(spans, ["doc_id", "h"]).select("doc_id", "h", "text", "lows", "highs"),
        _mapper(_kept, [*KEY, ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]),
        KEY_DDL + ", n_removed long, kept_sha256 string, kept_text string",
    )
    changed = changed.select("doc_id", "h", *wanted_columns).dropDuplicates(["doc_id", "h"])
    changed = settle(changed, "changed-documents")
    spark.sql(f"DROP TABLE {table}")
    return Found(scan.select("doc_id", "h", "n_words", "words_sha256"), changed)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, words, removed words and the digest of the kept words."""
    found = find(docs, key, text, ["n_removed", "kept_sha256"])
    return found.scan.join(found.changed, ["doc_id", "h"], "left").select(
        F.col("doc_id").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"),
    )


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated words; other white space stays. ``n_chars`` follows the text."""
    changed = find(docs, key, text, ["kept_text"]).changed.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("kept_text").alias("_kept"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).cast("long").alias("_doc"), F.xxhash64(text).alias("_text"))
    out = rows.join(changed, (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_h")), "left")
    new = {text: F.coalesce("_kept", F.col("_row")[text])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.coalesce(F.length("_kept").cast(kind), F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])

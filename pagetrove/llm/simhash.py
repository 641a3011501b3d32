"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is set if it is set in more than half of the hashes of a text's word
shingles. Bits are dealt to the nonzero vectors of radius + 1 bits; table v keeps the bits whose
vector has an odd product with v. At most ``radius`` differing bits leave some v that is orthogonal to
all their vectors, so every pair within the radius agrees in that table's masked value: none is missed.

Equal fingerprints are one class from the start. Within a table, classes of equal masked value
form a bucket; a bucket is compared in blocks and yields links that span what is connected, not
all pairs. Buckets above BUCKET_ROWS classes are handled exactly without comparing pairs: classes that agree
after clearing ``radius`` of the unmasked bits are within the radius, so each class looks for
its smallest companion under each such clearing.

Null and empty texts and those of white space only have fingerprint zero. Texts of fewer words
than a shingle are one shingle. Repeated rows and null ids keep their rows; the component is
the smallest id of its members, null if none has one. An empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .components import components
from .shipping import map_arrow, ship

BITS = 64
SEED = 42
BUCKET_ROWS = 8_192
BLOCK = 1_024


def fingerprint(text: str | None, shingle: int) -> int:
    """A-Z lowered, words split at ASCII white space, hashes of their UTF-8 shingles, majority per bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    grams = words if width == 1 else map(b" ".join, zip(*[words[k:] for k in range(width)]))
    n = len(words) - width + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8", n)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long."""
    kept = docs.select(*keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + "fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()]
            signed = pa.array(np.array(made, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [signed], names=[*batch.schema.names[:-1], "fp"])

    return map_arrow(docs.select(*keep, text), run, schema)


def masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask per nonzero vector v: the bits whose own vector has an odd product with v."""
    vectors = (1 << radius + 1) - 1
    own = [1 + bit % vectors for bit in range(bits)]
    return [
        sum(1 << bit for bit in range(bits) if (own[bit] & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> BITS - 1 else value


def _span(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the smallest place it is connected to, comparing block by block."""
    n = len(fps)
    label = np.arange(n)
    changed = True
    while changed:
        changed = False
        for i in range(0, n, BLOCK):
            for j in range(0, n, BLOCK):
                near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK]) <= radius
                best = np.where(near, label[None, j : j + BLOCK], n).min(axis=1)
                lower = best < label[i : i + BLOCK]
                if lower.any():
                    label[i : i + BLOCK] = np.minimum(label[i : i + BLOCK], best)
                    changed = True
        label = label[label]
    return label


def _bucket_links(radius: int):
    """Over rows sorted by table and masked value: links (a, b) that span each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def links(table: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(fps)]
            out_a, out_b = [], []
            sizes = ends - starts
            pair = starts[sizes == 2]
            near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius]
            out_a.append(fps[near])
            out_b.append(fps[near + 1])
            for k in np.flatnonzero(sizes > 2):
                own = fps[starts[k] : ends[k]]
                label = _span(own, radius)
                moved = np.flatnonzero(label != np.arange(len(own)))
                out_a.append(own[moved])
                out_b.append(own[label[moved]])
            a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            table, key, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            own = [table, key, fps.view(np.uint64)]
            if rest is not None:
                own = [np.concatenate(pair) for pair in zip(rest, own)]
            if not len(own[0]):
                continue
            last = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [c[cut:] for c in own]
            if cut:
                yield links(*[c[:cut] for c in own])
        if rest is not None:
            yield links(*rest)

    return run


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within the radius."""
    spark = classes.sparkSession
    ship(spark)
    tables = masks(radius)
    keys = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for t, mask in enumerate(tables)
    ])
    rows = classes.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    # Only buckets of two and more matter; their sizes come from an aggregate with partial sums.
    sizes = settle(rows.groupBy("t", "key").count().where("count > 1"), "buckets")
    shared = rows.join(sizes, ["t", "key"])
    small = shared.where(F.col("count") <= BUCKET_ROWS).select("t", "key", "fp")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = small.repartition(parts, "t", "key").sortWithinPartitions("t", "key")
    found = map_arrow_long(sorted_, _bucket_links(radius), "a long, b long")
    large = shared.where(F.col("count") > BUCKET_ROWS)
    if large.isEmpty():
        return found
    return found.unionByName(_large_links(large, tables, radius))


def map_arrow_long(df: DataFrame, function, schema: str) -> DataFrame:
    """``map_arrow`` for narrow rows of fixed width, where batches may be longer."""
    out = map_arrow(df, function, schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return out


def _large_links(rows: DataFrame, tables: list[int], radius: int) -> DataFrame:
    """Each class and its smallest companion under each clearing of ``radius`` unmasked bits."""
    def clearings(mask: int) -> Column:
        free = [bit for bit in range(BITS) if not mask >> bit & 1]
        return F.array(*[
            F.lit(_signed((1 << BITS) - 1 - sum(1 << bit for bit in bits))) for bits in combinations(free, radius)
        ])

    choice = F.lit(None).cast("array<bigint>")
    for t, mask in enumerate(tables):
        choice = F.when(F.col("t") == t, clearings(mask)).otherwise(choice)
    spread = rows.select("fp", F.explode(choice).alias("keep"))
    spread = spread.select("fp", "keep", F.col("fp").bitwiseAND(F.col("keep")).alias("rest"))
    least = spread.groupBy("keep", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread.join(least, ["keep", "rest"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def cluster(
    docs: DataFrame, shingle: int, radius: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """key, ``keep``, fp and component_id, one row per document."""
    own = settle(fingerprints(docs, shingle, [key, *keep], text), "fingerprints")
    classes = settle(own.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    labels = components(near_links(classes.select("fp"), radius), "simhash-links")
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "component").select("fp", "component_id")
    return own.join(of_class, "fp").select(key, *keep, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int, radius: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents of a component that are not its smallest id.

    Rows without an id stay; of rows that share the smallest id all stay. Rows that share an id
    are told apart by the hash of their text.
    """
    # The row travels as one value, so its columns may have any names.
    hashed = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("id"), F.col(text).alias("words"), F.xxhash64(text).alias("hash"))
    lost = cluster(hashed, shingle, radius, "id", "words", ("hash",)).where("id != component_id")
    rest = hashed.join(lost.select("id", "hash").distinct(), ["id", "hash"], "left_anti")
    return rest.select("row.*")

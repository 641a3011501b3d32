"""Histogram sort: exact splitters by counted probes, then one exchange.

Documents are ordered by (hash of the text, hash of the id), so equal texts lie side by side
and a group of copies is cut only where a shard ends. Each round counts the exact bytes below
evenly spaced key boundaries inside the brackets that still hold a splitter; brackets shrink by
a factor of 2 ** PROBE_BITS until the bytes in each meet the tolerance. The counts of a round are at
most shards * 2 ** PROBE_BITS numbers, whatever the table holds.

Null text has size OVERHEAD and the hash of null; a null id is an id like others. Rows that
are equal in text and id share a key and cannot be told apart, so they stay in one shard. An
empty table gives an empty result. Columns of the input that clash with the added ones are
replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

OVERHEAD = 8
PROBE_BITS = 12
TOLERANCE = 0.001
CHUNK_ROWS = 100_000
CHUNK_BYTES = 1 << 20
WIDTH = 62


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and the overhead of a row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _part(value: Column, bits: Column | int) -> Column:
    return F.shiftrightunsigned(value, bits)


def _brackets(keys: DataFrame, targets: list[int], tolerance: float) -> list[tuple[int, int]]:
    """For each target the smallest probed (hash, id hash) boundary with at least so many bytes below.

    A splitter starts with all hashes as its bracket. Once a single hash holds more than the
    tolerance, the id hash is probed within it.
    """
    found: list[tuple[int, int] | None] = [None] * len(targets)
    # Per splitter: level (0 hash, 1 id hash), fixed hash, prefix, bits left, bytes below the bracket.
    open_ = {i: (0, 0, 0, WIDTH, 0) for i in range(len(targets))}
    while open_:
        counted: dict[tuple[int, int, int, int], list[tuple[int, int, int]]] = {}
        for bracket in {v[:4] for v in open_.values()}:
            counted[bracket] = []
        probes = []
        for level, fixed, prefix, bits in counted:
            step = max(0, bits - PROBE_BITS)
            here = F.lit(True) if bits == WIDTH else _part(F.col("h") if level == 0 else F.col("d"), bits) == prefix
            if level == 1:
                here = here & (F.col("h") == fixed)
            value = F.col("h") if level == 0 else F.col("d")
            probes.append(F.when(here, F.struct(
                F.lit(level).alias("level"), F.lit(fixed).cast("long").alias("fixed"),
                F.lit(prefix).cast("long").alias("prefix"), F.lit(bits).alias("bits"),
                _part(value, step).alias("probe"),
            )))
        hits = keys.select("size", F.explode(F.array_compact(F.array(*probes))).alias("at"))
        sums = hits.groupBy("at").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        for at, size, rows in sums.collect():
            counted[at["level"], at["fixed"], at["prefix"], at["bits"]].append((at["probe"], size, rows))
        for i, (level, fixed, prefix, bits, below) in list(open_.items()):
            step = max(0, bits - PROBE_BITS)
            total = below
            for probe, size, rows in sorted(counted[level, fixed, prefix, bits]):
                if total + size >= targets[i]:
                    break
                total += size
            if size <= tolerance or rows == 1 or (step == 0 and level == 1):
                # The whole probe goes to the nearer side of the splitter.
                after = probe + (total + size - targets[i] <= targets[i] - total)
                found[i] = ((after << step), 0) if level == 0 else (fixed, after << step)
                del open_[i]
            elif step == 0:
                open_[i] = (1, probe, 0, WIDTH, total)
            else:
                open_[i] = (level, fixed, probe, step, total)
    return found


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot; sizes per shard differ by the tolerance or one row.

    ``slot`` counts from 0 in each shard without gaps. Rows are exchanged once, by shard and
    chunk, with all their columns; a chunk holds some CHUNK_ROWS rows and CHUNK_BYTES bytes at
    most, so no task gets a whole shard.
    """
    clear = (1 << WIDTH) - 1
    # The row travels as one value, so its columns may have any names.
    spread = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")]).alias("row"),
        row_size(F.col(text)).alias("size"),
        F.xxhash64(text).bitwiseAND(F.lit(clear)).alias("h"),
        F.xxhash64(F.lit(shards), key).bitwiseAND(F.lit(clear)).alias("d"),
    )
    keys = settle(spread.select("size", "h", "d"), "shard-keys")
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = [total * i // shards for i in range(1, shards)] if rows else []
    cuts = sorted(_brackets(keys, targets, TOLERANCE * total / shards))

    def shard_of(h: Column, d: Column) -> Column:
        number = F.lit(0)
        for cut_h, cut_d in cuts:
            number = number + ((h > cut_h) | ((h == cut_h) & (d >= cut_d))).cast("int")
        return number

    chunks = max(1, round(rows / shards / CHUNK_ROWS), round(total / shards / CHUNK_BYTES))
    chunk = F.pmod(F.col("d"), F.lit(chunks))
    shard_number = shard_of(F.col("h"), F.col("d"))
    counts = keys.select(shard_number.alias("shard"), chunk.alias("chunk")).groupBy("shard", "chunk").count()
    earlier = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("count").over(earlier)
    first = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("first"))
    placed = spread.withColumn("shard", shard_number).withColumn("chunk", chunk)
    local = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("h", "d"))
    numbered = placed.withColumn("local", local)
    return numbered.join(first, ["shard", "chunk"]).select(
        "row.*", "size", "shard", (F.col("first") + F.col("local") - 1).cast("long").alias("slot"))

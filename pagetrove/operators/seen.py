"""Repeat sightings of a key within a time-to-live.

The rule: a sighting is emitted if its key was not emitted during the ``ttl``
before it. A suppressed sighting does not restart the clock. (This is the stated
purpose of a seen-URL cache with expiry; a cache check that lets everything pass
is not reproduced.)

The rule is sequential per key, so a key with very many sightings must not be
one task's work. Its time is cut into chunks. What a chunk does depends only on
when it may first emit, an instant less than one TTL after its start: a step
function, kept as rows (key, chunk, upto, leave). Step functions of neighbouring
chunks compose. Heavy keys are solved by composing pairs of chunks, pairs of
pairs and so on, until one chunk is left, which is entered free; then entries are
handed back down. Each level halves the number of functions and none has more
steps than a TTL has sightings, so all levels together move about twice the
sightings. Arrays hold at most ``fold_rows`` or ``chunk_rows`` instants; a chunk whose
TTL has more is kept as rows. Two chunks meet in a sort by (key, pair), which spills; where
one TTL holds most of a key's sightings, that sort is as large as they are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, settle_counted

# Sightings of a key up to which they are walked as one sorted array.
FOLD_ROWS = 1_024

# Sightings of a chunk that are handled as one array. A walk copies what it has emitted
# at every step, so arrays are kept short.
CHUNK_ROWS = 1_024

# Heavy keys up to which their list is broadcast: they are longs or URLs of limited length.
BROADCAST_KEYS = 100_000

# Before any instant.
_EVER = -(1 << 62)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def seen_within_ttl(
    sightings: DataFrame, ttl: int, fold_rows: int = FOLD_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Emitted sightings of a table (key, t, id); ``t`` and ``ttl`` in one unit.

    Of sightings at the same instant the smallest id counts. Keys with more than
    ``fold_rows`` instants take the distributed way; the result is the same.
    """
    instants = settle(
        sightings.where(F.col("key").isNotNull())
        .groupBy("key", F.col("t").cast("long").alias("t"))
        .agg(F.min(F.col("id").cast("long")).alias("id")),
        "instants",
    )
    sizes = instants.groupBy("key").agg(F.count("*").alias("n"))
    heavy, n_heavy = settle_counted(sizes.where(F.col("n") > fold_rows).select("key"), "heavy")
    if n_heavy == 0:
        return _walk(instants, ["key"], F.lit(_EVER), ttl)
    if n_heavy <= BROADCAST_KEYS:
        heavy = F.broadcast(heavy)
    light = _walk(instants.join(heavy, "key", "left_anti"), ["key"], F.lit(_EVER), ttl)
    return light.unionByName(_compose(instants.join(heavy, "key", "left_semi"), ttl, chunk_rows))


def _walk(instants: DataFrame, group: list[str], due: Column, ttl: int) -> DataFrame:
    """Emitted (key, t, id), each group walked in time order; ``due`` is when it may first emit."""
    start = F.struct(
        due.cast("long").alias("due"), F.array().cast("array<struct<t:bigint,id:bigint>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        emitted = F.struct((x["t"] + F.lit(ttl)).alias("due"), F.array_append(acc["out"], x).alias("out"))
        return F.when(x["t"] >= acc["due"], emitted).otherwise(acc)

    grouped = instants.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("all"))
    return grouped.select(
        "key", F.inline(F.aggregate(F.col("all"), start, step, lambda acc: acc["out"]))
    )


def _compose(instants: DataFrame, ttl: int, chunk_rows: int) -> DataFrame:
    """Emitted sightings of heavy keys; no step needs a whole key in one task."""
    # A chunk is as many TTLs as still fit an array everywhere, at least one.
    slices = instants.groupBy(
        "key", F.expr(f"(t - pmod(t, {ttl}L)) div {ttl}L").alias("slice")
    ).agg(F.count("*").alias("n"))
    low, high, densest = slices.agg(F.min("slice"), F.max("slice"), F.max("n")).first()
    doublings = min((chunk_rows // densest).bit_length() - 1, (high - low).bit_length())
    in_arrays = doublings >= 0
    width = ttl << max(doublings, 0)
    since = F.col("t") - F.lit(low * ttl)
    at = F.pmod(since, F.lit(width))
    placed = settle(
        instants.select(
            "key", F.expr(f"(t - {low * ttl}L) div {width}L").alias("chunk"), at.alias("at"), "t", "id"
        ),
        "chunks",
    )
    functions = _array_functions(placed, ttl, width) if in_arrays else _slice_functions(placed, ttl)
    levels = [settle(functions, "level")]
    while not levels[-1].where("chunk > 0").isEmpty():
        levels.append(settle(_join_pairs(levels[-1], ttl), "level"))
    free = levels[-1].select("key", "chunk").distinct().withColumn("enter", F.lit(0).cast("long"))
    entries = settle(free, "entries")
    for level in reversed(levels[:-1]):
        entries = settle(_enter_halves(entries, level), "entries")
    # What came before the entry of a chunk cannot be emitted.
    due = placed.join(entries, ["key", "chunk"]).where(F.col("at") >= F.col("enter"))
    if in_arrays:
        return _walk(due, ["key", "chunk"], F.lit(_EVER), ttl)
    first = due.groupBy("key", "chunk").agg(F.min(F.struct("t", "id")).alias("first"))
    return first.select("key", "first.t", "first.id")


def _slice_functions(placed: DataFrame, ttl: int) -> DataFrame:
    """Step functions of chunks one TTL long.

    Entered at ``upto`` or before, but after the previous row's ``upto``, the
    chunk leaves the next one due at ``leave``; 0 means free from its start. It
    emits its first instant not before the entry, and nothing past its last.
    """
    past_end = placed.select("key", "chunk").distinct().select(
        "key", "chunk", F.lit(ttl).cast("long").alias("upto"), F.lit(0).cast("long").alias("leave")
    )
    steps = placed.select("key", "chunk", F.col("at").alias("upto"), F.col("at").alias("leave"))
    return steps.unionByName(past_end)


def _array_functions(placed: DataFrame, ttl: int, width: int) -> DataFrame:
    """Step functions of longer chunks: one walk for every way to enter."""
    chunks = placed.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("at")).alias("all"))
    ttl_long = F.lit(ttl).cast("long")
    ways = F.array_append(F.filter("all", lambda a: a < ttl_long), ttl_long)

    def leave(enter: Column) -> Column:
        last_due = F.aggregate(
            F.col("all"), enter, lambda due, a: F.when(a >= due, a + ttl_long).otherwise(due)
        )
        return F.greatest(last_due - F.lit(width), F.lit(0))

    steps = F.transform(ways, lambda e: F.struct(e.alias("upto"), leave(e).alias("leave")))
    return chunks.select("key", "chunk", F.inline(steps))


def _join_pairs(functions: DataFrame, ttl: int) -> DataFrame:
    """Compose chunk 2i with chunk 2i+1 into chunk i of the next level.

    A missing chunk had no sightings: it leaves its successor free.
    """
    left = F.col("chunk") % 2 == 0
    pair = functions.select(
        "key",
        F.shiftright("chunk", 1).alias("pair"),
        left.alias("left"),
        "upto",
        "leave",
        # Where on the boundary between the two chunks the row sits.
        F.when(left, F.col("leave")).otherwise(F.col("upto")).alias("between"),
    )
    # From late to early, the right row last passed is the one a left row enters.
    later = Window.partitionBy("key", "pair").orderBy(F.desc("between"), F.asc("left"))
    whole = Window.partitionBy("key", "pair")
    entered = F.last(F.when(~F.col("left"), F.col("leave")), ignorenulls=True).over(
        later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = pair.select(
        "key",
        "pair",
        "left",
        "upto",
        F.coalesce(entered, F.lit(0)).alias("leave"),
        F.max("left").over(whole).alias("has_left"),
        F.min(F.when(~F.col("left"), F.col("upto"))).over(whole).alias("first_right"),
    )
    # Without a left chunk the right one is entered free: only its first step remains.
    alone = ~F.col("has_left") & (F.col("upto") == F.col("first_right"))
    kept = joined.where(F.col("left") | alone).select(
        "key",
        "pair",
        F.when(F.col("left"), F.col("upto")).otherwise(F.lit(ttl).cast("long")).alias("upto"),
        "leave",
    )
    # Neighbouring steps with one result are one step.
    following = F.lead("leave").over(Window.partitionBy("key", "pair").orderBy("upto"))
    merged = kept.withColumn("following", following)
    return merged.where(
        F.col("following").isNull() | (F.col("following") != F.col("leave"))
    ).select("key", F.col("pair").alias("chunk"), "upto", "leave")


def _enter_halves(entries: DataFrame, halves: DataFrame) -> DataFrame:
    """From the entry of each chunk to the entries of its two halves, where present."""
    side = halves.select("key", "chunk", "upto", "leave", F.shiftright("chunk", 1).alias("pair"))
    whole = entries.select("key", F.col("chunk").alias("pair"), "enter")
    left = F.col("chunk") % 2 == 0
    reached = F.when(left & (F.col("upto") >= F.col("enter")), F.struct("upto", "leave"))
    both = side.join(whole, ["key", "pair"]).groupBy("key", "pair", "enter").agg(
        F.min(reached)["leave"].alias("leave"),
        F.max(left).alias("has_left"),
        F.max(~left).alias("has_right"),
    )
    first = F.when(F.col("has_left"), F.struct((F.col("pair") * 2).alias("chunk"), F.col("enter").alias("enter")))
    second = F.when(
        F.col("has_right"),
        F.struct((F.col("pair") * 2 + 1).alias("chunk"), F.coalesce("leave", F.lit(0)).alias("enter")),
    )
    return both.select("key", F.inline(F.array_compact(F.array(first, second))))


def glob_to_regex(glob: str) -> str:
    """Key patterns of a cache: ``*``, ``?``, ``[abc]``, ``[^a]``, ``[a-z]``, ``\\`` escapes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 1)
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > i + 1:
            body = glob[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            escaped = "".join(f"\\{x}" if x in "\\[]^&" else x for x in body)
            out.append(f"[{'^' if negated else ''}{escaped}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(f"\\{glob[i]}" if not glob[i].isalnum() else glob[i])
        else:
            out.append(f"\\{c}" if not c.isalnum() else c)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def seen_lookup(seen: DataFrame, glob: str, column: str = "url") -> DataFrame:
    """Seen keys that match a glob pattern."""
    return seen.where(F.col(column).rlike(glob_to_regex(glob)))

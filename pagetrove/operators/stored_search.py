"""Search over the store without reading all of it.

Trigram signatures rule out files that hold no match. The rest is read in the order of ids, a few files first and
then more and more, until the wanted number of rows is found: files hold ascending ids, so what comes later
cannot come first. A common word ends after a few files, a rare one reads the few that may hold it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grams import pattern_places
from ..functions.patterns import make_pattern
from ..schemas import STORED_DOC
from ..session import settle, settle_counted
from ..sources.store import BATCH, RUN, batch_folder, read_side, scan_store
from .search import RESULT_LIMIT, matches

# Files of the first round, how much larger each round is than the one before, and the largest round.
FIRST_FILES, GROWTH, MOST_FILES = 4, 4, 4_096

# Trigrams of a query that are looked up; fewer rule out less, never too much.
MOST_PLACES = 256

_FILE = ["first", RUN, BATCH, "file"]


def candidate_files(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Files that may hold a match: (file, first, last, rows, run, batch).

    Queries without three literal characters in a row rule nothing out.
    """
    files = read_side(spark, path, "_files")
    masks: dict[int, int] = {}
    for place in pattern_places(spark, make_pattern(query))[:MOST_PLACES]:
        masks[place >> 6] = masks.get(place >> 6, 0) | 1 << (place & 63)
    if not masks:
        return files
    signed = {word: mask - (1 << 64) if mask >> 63 else mask for word, mask in masks.items()}
    wanted = F.create_map(*[F.lit(v) for pair in signed.items() for v in pair])
    mask = F.element_at(wanted.cast("map<int,bigint>"), F.col("word"))
    # Signatures are sorted by word, so only the stretches with these words are read.
    there = read_side(spark, path, "_grams").where(F.col("word").isin(list(signed)))
    full = there.where(F.col("bits").bitwiseAND(mask) == mask).groupBy("file", RUN, BATCH).count()
    return files.join(full.where(F.col("count") == len(signed)), ["file", RUN, BATCH], "left_semi")


def search_stored(spark: SparkSession, path: str, query: str | None, limit: int = RESULT_LIMIT) -> DataFrame:
    """``search`` over the store: the first ``limit`` matching rows by id."""
    if not query:
        return scan_store(spark, path).limit(0)
    files = settle(candidate_files(spark, path, query), "candidate-files")
    found, rows, take, after = spark.createDataFrame([], STORED_DOC), 0, FIRST_FILES, None
    while True:
        left = files
        if after is not None:
            left = files.where(F.struct(*_FILE) > F.struct(*[F.lit(after[c]).alias(c) for c in _FILE]))
        chunk = left.orderBy(*_FILE).limit(take + 1).collect()  # a bounded number of names
        now, more = chunk[:take], chunk[take:]
        if now:
            hits, n = settle_counted(_first_rows(spark, path, now, query, limit), "hits")
            found, rows = found.unionByName(hits), rows + n
            after = now[-1]
        if not more:
            break
        if rows >= limit:
            # Ids of later files are higher, unless several writers shared the store.
            last = found.orderBy("id").limit(limit).agg(F.max("id")).first()[0]
            if more[0]["first"] > last:
                break
        take = min(take * GROWTH, MOST_FILES)
    return found.orderBy("id").limit(limit)


def _first_rows(spark: SparkSession, path: str, files: list, query: str, limit: int) -> DataFrame:
    paths = [f"{path}/{batch_folder(f[RUN], f[BATCH])}/{f['file']}" for f in files]
    return spark.read.schema(STORED_DOC).parquet(*paths).where(matches(query)).orderBy("id").limit(limit)

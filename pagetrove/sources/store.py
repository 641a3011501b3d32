"""The document store: parquet files sorted by id, one folder per run and batch, and what finds rows in them.

Batches are named by the run that writes them and their number in it, so streams and batch jobs
on one store never replace each other's rows, while a batch that is run again replaces itself. One
writer at a time: ids go on from the highest one given out.

Beside the documents, hidden from readers of the store by a leading underscore, each batch keeps
``_urls`` (its URLs, split by a hash of them), ``_blooms`` (a Bloom filter for each of these parts),
``_files`` and ``_grams`` (id bounds and a signature of character trigrams for each document file)
and ``_last_ids``. A batch that failed on the way counts once it has been run again.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grams import gram_place, grams
from ..schemas import STORED_COLUMNS, STORED_DOC
from ..session import settle

RUN, BATCH, PART = "ingest_run", "ingest_batch", "url_part"
_OWNER = [T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType())]
_LAYOUT = T.StructType(STORED_DOC.fields + _OWNER)

# Side tables by name, without the columns that name the batch.
_SIDES = {
    "_urls": f"url string, {PART} int",
    "_blooms": f"words long, word long, bits long, {PART} int",
    "_files": "file string, first long, last long, rows long",
    "_grams": "word int, bits long, file string",
    "_last_ids": "last long",
}

# Parts of a batch's URLs.
PARTS = 32

# URLs are at most 255 characters, so this many are below 100 MB and safe to broadcast.
BROADCAST_URLS = 100_000

# Documents of a file, columns that are searched.
FILE_ROWS = 100_000
SEARCHED = ("title", "description", "content")

# A Bloom filter has a 64-bit word for every two URLs and sets BLOOM_BITS bits in one word per URL; about one
# URL in five thousand that is not there passes. Numbers of words are powers of two, so that few differ.
BLOOM_BITS = 6

# URLs of a part that one task writes, about.
SHARE_ROWS = 1_000_000

# Parts of batches that are named in a filter; beyond that their list would be longer than it saves.
NAMED_PARTS = 1_024


def url_part(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(PARTS)).cast("int")


def create_store(spark: SparkSession, path: str) -> None:
    """Create an empty store unless there is one."""
    spark.createDataFrame([], _LAYOUT).write.mode("ignore").partitionBy(RUN, BATCH).parquet(path)
    context = spark.sparkContext
    for name in _SIDES:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(folder)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows with the run and number of the batch that wrote them."""
    return spark.read.schema(_LAYOUT).parquet(path)


def read_side(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A side table of all batches."""
    return spark.read.schema(f"{_SIDES[name]}, {RUN} string, {BATCH} long").parquet(f"{path}/{name}")


def batch_folder(run: str, batch: int) -> str:
    return f"{RUN}={run}/{BATCH}={batch}"


def is_batch(run: str, batch: int) -> Column:
    return (F.col(RUN) == run) & (F.col(BATCH) == batch)


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """The seven stored columns."""
    return read_store(spark, path).select(*STORED_COLUMNS)


def store_view(spark: SparkSession, path: str, name: str) -> None:
    """Make the store readable by name in SQL."""
    scan_store(spark, path).createOrReplaceTempView(name)


def to_stored_doc(docs: DataFrame) -> DataFrame:
    """Stored column order, heading list already turned to text."""
    return docs.select(
        "id",
        "author",
        F.col("content_text").alias("content"),
        "description",
        "published_date",
        "title",
        "url",
    )


def append_store(
    docs: DataFrame, path: str, run: str, batch: int, last: int | None = None, file_rows: int = FILE_ROWS
) -> None:
    """Write one batch and what finds it. Running the same batch of the same run again replaces it.

    ``last``: highest id given out by this batch, stored or not.
    """
    spark, own = docs.sparkSession, batch_folder(run, batch)
    written, found = Observation(), docs.select(*STORED_COLUMNS).repartitionByRange("id").sortWithinPartitions("id")
    found.observe(written, F.count(F.lit(1)).alias("rows"), F.max("id").alias("last")).write.mode("overwrite").option(
        "maxRecordsPerFile", file_rows).parquet(f"{path}/{own}")
    rows = spark.read.schema(STORED_DOC).parquet(f"{path}/{own}")

    def side(name: str, table: DataFrame, *split: str) -> None:
        table.write.mode("overwrite").partitionBy(*split).parquet(f"{path}/{name}/{own}")

    # Dealt out by part first, else every task writes a file for each of them.
    urls, share = rows.select("url", url_part(F.col("url")).alias(PART)), -(-written.get["rows"] // (PARTS * SHARE_ROWS))
    side("_urls", urls.repartition(PART, F.pmod(F.xxhash64("url", F.lit("share")), F.lit(max(share, 1)))), PART)
    held = spark.read.schema(_SIDES["_urls"]).parquet(f"{path}/_urls/{own}")
    side("_blooms", bloom_words(held, written.get["rows"]), PART)
    in_files = rows.select("*", F.col("_metadata.file_name").alias("file"))
    side("_files", in_files.groupBy("file").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")))
    side("_grams", file_grams(in_files).repartitionByRange("word").sortWithinPartitions("word"))
    highest = max((n for n in (last, written.get["last"]) if n is not None), default=None)
    side("_last_ids", spark.createDataFrame([(highest,)], _SIDES["_last_ids"]).coalesce(1))


def file_grams(in_files: DataFrame) -> DataFrame:
    """(word, bits, file): which trigrams occur in a file, as words of a bitmap; combined per task before the shuffle."""
    # A gram across two columns is none of either, so they are kept apart by what no text is matched across.
    every = F.concat_ws("\u0000\u0000\u0000", *SEARCHED)
    found = in_files.select("file", F.explode(grams(every)).alias("gram")).select("file", gram_place(F.col("gram")).alias("p"))
    return found.groupBy(F.shiftright("p", 6).cast("int").alias("word"), "file").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(p & 63 AS int)"))).alias("bits")
    ).select("word", "bits", "file")


def _bloom_mask(url: Column) -> Column:
    mask = F.lit(0).cast("long")
    for seed in range(BLOOM_BITS):
        bit = F.pmod(F.xxhash64(url, F.lit(seed)), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _bloom_word(url: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("word")), words.cast("long"))


def bloom_words(urls: DataFrame, rows: int) -> DataFrame:
    """(words, word, bits, part) of the ``rows`` URLs of a batch; words without a bit are left out."""
    words = 1 << max(0, (rows // PARTS - 1) // 2).bit_length()
    word = _bloom_word(F.col("url"), F.lit(words))
    return urls.groupBy(F.lit(words).cast("long").alias("words"), word.alias("word"), PART).agg(
        F.bit_or(_bloom_mask(F.col("url"))).alias("bits")).select("words", "word", "bits", PART)


def admitted(urls: DataFrame, blooms: DataFrame) -> DataFrame:
    """(url, part, run, batch): batches whose filters do not rule a URL out. ``urls`` are few enough to broadcast."""
    sizes = [row[0] for row in blooms.select("words").distinct().collect()]  # powers of two
    each = F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<bigint>")).alias("words")
    probes = urls.select("url", url_part(F.col("url")).alias(PART), each).select(
        "*", _bloom_word(F.col("url"), F.col("words")).alias("word"), _bloom_mask(F.col("url")).alias("mask"))
    met = blooms.join(F.broadcast(probes), [PART, "words", "word"])
    return met.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("url", PART, RUN, BATCH)


def stored_urls(spark: SparkSession, path: str, urls: DataFrame, others: Column) -> DataFrame:
    """Those of the few ``urls`` that batches under the condition ``others`` hold.

    Filters are read whole, at 4 bytes a stored URL; URLs only of the parts that some filter admits.
    """
    few = settle(urls.select("url").distinct(), "batch-urls")
    maybe = settle(admitted(few, read_side(spark, path, "_blooms").where(others)), "admitted")
    parts = maybe.select(RUN, BATCH, PART).distinct().limit(NAMED_PARTS + 1).collect()
    held = read_side(spark, path, "_urls").where(others)
    if len(parts) <= NAMED_PARTS:
        held = held.where(_named(parts))
    return held.join(F.broadcast(maybe), ["url", RUN, BATCH, PART], "left_semi").select("url")


def _named(parts: list) -> Column:
    """Rows of the given (run, batch, part); on partition columns only, so other files are not opened."""
    batches: dict[tuple, list[int]] = {}
    for run, batch, part in parts:
        batches.setdefault((run, batch), []).append(part)
    condition = F.lit(False)
    for (run, batch), own in batches.items():
        condition = condition | (is_batch(run, batch) & F.col(PART).isin(own))
    return condition


def not_stored(
    spark: SparkSession, path: str, docs: DataFrame, urls: DataFrame, rows: int, others: Column
) -> DataFrame:
    """Documents whose URL no batch under the condition ``others`` holds.

    ``urls`` are theirs, ``rows`` an upper bound of their number. Few URLs are looked up by way of the Bloom filters and the known
    ones broadcast. Many are joined by URL with the URLs of their parts; both sides hold each
    URL once, so no key is hot.
    """
    if rows <= BROADCAST_URLS:
        return docs.join(F.broadcast(stored_urls(spark, path, urls, others)), "url", "left_anti")
    held = read_side(spark, path, "_urls").where(others & F.col(PART).isin(touched_parts(urls)))
    return docs.join(held.select("url"), "url", "left_anti")


def touched_parts(urls: DataFrame) -> list[int]:
    """URL parts of a batch, at most PARTS numbers."""
    return [row[0] for row in urls.select(url_part(F.col("url"))).distinct().collect()]


def next_id(spark: SparkSession, path: str, run: str, batch: int) -> int:
    """Smallest id above all given out by other batches; one small row per batch is read."""
    others = read_side(spark, path, "_last_ids").where(~is_batch(run, batch))
    return (others.agg(F.max("last")).first()[0] or 0) + 1

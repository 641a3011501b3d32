"""Page feeds: JSON lines, one page per line, 25 pages per object; JSON arrays are read too."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..schemas import FEED_LINE, RAW_PAGE
from ..session import settle

# Fixed value: pages per feed object.
ITEMS_PER_OBJECT = 25


def with_position(df: DataFrame) -> DataFrame:
    """Add where each line came from: file, offset of the split, place inside it.

    ``_seq`` only grows inside a split, which is all that ordering lines needs;
    ``_file, _block, _seq`` together are the arrival order.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed lines with position; an undecodable line is kept as ``_corrupt_record``."""
    reader = spark.read.schema(FEED_LINE).option("mode", "PERMISSIVE")
    return with_position(reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def read_feed_array(spark: SparkSession, path: str) -> DataFrame:
    """Feeds written as one JSON array of objects per file, read by as many tasks as a file has splits.

    A file is read in fragments that end at a closing brace. Which of these end a record depends on whether they stand
    inside a string, and on how many braces are open there: parities of quotes and sums of braces over all
    fragments before. Each split is summed on its own, for either way it may begin, and the sums of
    splits are composed. Fragments are written once with their counts; running sums read the counts
    only. Then the fragments of a record are brought together. ``_seq`` is the record's place in its file. What follows an
    array that is cut off or malformed is kept as ``_corrupt_record``.
    """
    found = with_position(spark.read.option("lineSep", "}").text(path))
    # Escapes stand in strings only, and a brace is never escaped, so no escape reaches across fragments.
    bare = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    counted = found.withColumn("_bare", bare)

    def opened(odd: int) -> Column:
        """Opening braces outside of strings if the fragment begins outside (0) or inside (1) of one."""
        outside = F.array_join(F.filter("_bare", lambda x, i: i % 2 == odd), "")
        return F.length(outside) - F.length(F.replace(outside, F.lit("{")))

    fragments = settle(counted.select(
        *found.columns, ((F.size("_bare") - 1) % 2).alias("_quotes"), opened(0).alias("_open0"), opened(1).alias("_open1")
    ), "fragments")

    split = ["_file", "_block"]
    to_here = Window.partitionBy(*split).orderBy("_seq")
    before = to_here.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def sum_of(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    counts = fragments.select(*split, "_seq", "_quotes", "_open0", "_open1").withColumn("_q", sum_of("_quotes", before) % 2)
    for begins in (0, 1):  # outside or inside of a string
        inside = (F.col("_q") + begins) % 2
        ends = F.when((inside + F.col("_quotes")) % 2 == 0, 1).otherwise(0)
        counts = counts.withColumn(f"_ends{begins}", ends).withColumn(
            f"_step{begins}", F.when(inside == 0, F.col("_open0")).otherwise(F.col("_open1")) - ends)
    for begins in (0, 1):
        counts = counts.withColumn(f"_depth{begins}", F.sum(f"_step{begins}").over(to_here))
    counts = settle(counts, "fragment-depths")

    sums = counts.groupBy(*split).agg(
        F.sum("_quotes").alias("_quotes"), F.sum("_step0").alias("_step0"), F.sum("_step1").alias("_step1"))
    sums = sums.withColumn("_begins", sum_of("_quotes", earlier) % 2)
    sums = sums.withColumn("_step", F.when(F.col("_begins") == 0, F.col("_step0")).otherwise(F.col("_step1")))
    starts = sums.select(*split, "_begins", sum_of("_step", earlier).alias("_before"))

    def of(name: str) -> Column:
        return F.when(F.col("_begins") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    last = (of("_ends") == 1) & (of("_depth") + F.col("_before") == 0)
    ended = settle(counts.join(starts, split).select(*split, "_seq", last.cast("int").alias("_last")), "record-ends")
    records = ended.groupBy(*split).agg(F.sum("_last").alias("_n"))
    records = records.select(*split, sum_of("_n", earlier).alias("_first"))
    placed = ended.join(records, split).select(
        *split, "_seq", "_last", (F.col("_first") + sum_of("_last", before)).alias("_record"))

    parts = F.sort_array(F.collect_list(F.struct("_block", "_seq", "value")))
    whole = fragments.select(*split, "_seq", "value").join(placed, [*split, "_seq"]).groupBy("_file", "_record").agg(
        parts.alias("_parts"), F.max("_last").alias("_last"))
    text = F.concat(F.array_join("_parts.value", "}"), F.when(F.col("_last") == 1, F.lit("}")).otherwise(F.lit("")))
    objects = whole.select(
        "_file", F.get("_parts._block", F.lit(0)).alias("_block"), F.col("_record").alias("_seq"),
        F.regexp_replace(text, r"^[\s,\[\]]+", "").alias("_json")).where("_json <> ''")
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return objects.select(F.from_json("_json", FEED_LINE, mode).alias("_r"), "_file", "_block", "_seq").select(
        "_r.*", "_file", "_block", "_seq")


def write_feed(
    pages: DataFrame, path: str, mode: str = "errorifexists", per_object: int = ITEMS_PER_OBJECT
) -> None:
    """Write JSON-lines objects of at most ``per_object`` pages each, without any shuffle.

    25 is the contract of the feed; for large feeds that need not keep to it,
    objects of some 100 MB are read back far faster.
    """
    items = pages.select(*RAW_PAGE.names)
    # Explicit nulls, so that a missing key and a null value stay apart.
    items.write.mode(mode).option("maxRecordsPerFile", per_object).option(
        "ignoreNullFields", False
    ).json(path)


def number_batches(pages: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx`` (0-based place in ``order``) and ``batch_id`` (1-based object number)."""
    idx = F.col("_number") - 1
    return number_rows(pages, order).select(
        "*", idx.alias("idx"), (F.floor(idx / ITEMS_PER_OBJECT) + 1).alias("batch_id")
    ).drop("_number")


def write_numbered_feed(pages: DataFrame, path: str, order: list[str]) -> None:
    """As ``write_feed`` with exact object numbers, one folder ``batch_id=<n>`` each.

    Every object is written by one task, because rows are range-partitioned by
    its number.
    """
    numbered = number_batches(pages, order)
    (
        numbered.repartitionByRange("batch_id")
        .sortWithinPartitions("batch_id", "idx")
        .select(*RAW_PAGE.names, "batch_id")
        .write.option("ignoreNullFields", False)
        .partitionBy("batch_id")
        .json(path)
    )

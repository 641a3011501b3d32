"""Bad records are set aside with a reason; the rest of the feed goes on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ORDER
from .dedup import unique_url
from .parse import fit_columns, is_valid, parse_pages, too_long, with_content_text


def line_fault() -> Column:
    """What is wrong with a feed line before its page is even parsed."""
    return (
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("corrupt_json"))
        .when(F.col("url").isNull(), F.lit("missing_url"))
        .when(F.col("content").isNull(), F.lit("missing_content"))
    )


def judge(lines: DataFrame) -> DataFrame:
    """Parse feed lines and add ``reject_reason``, null for good documents.

    Row by row, no shuffle. Duplicates are not known yet at this point.
    """
    if "_corrupt_record" not in lines.columns:
        lines = lines.withColumn("_corrupt_record", F.lit(None).cast("string"))
    marked = lines.withColumn("_fault", line_fault())
    parsed = with_content_text(parse_pages(marked.drop("_corrupt_record")))
    reason = F.coalesce(F.col("_fault"), F.when(~is_valid(), F.lit("invalid")), too_long())
    return fit_columns(parsed.withColumn("reject_reason", reason).drop("_fault"))


def set_aside(judged: DataFrame, kept: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Every record that was not kept, with its reason: (url, reject_reason, order columns).

    Good documents that are missing from ``kept`` are copies of a kept URL. They
    are found by position: narrow rows and a key that is never hot.
    """
    good = judged.where(F.col("reject_reason").isNull())
    copies = good.select("url", F.lit("duplicate_url").alias("reject_reason"), *order).join(
        kept.select(*order), order, "left_anti"
    )
    faulty = judged.where(F.col("reject_reason").isNotNull())
    return faulty.select("url", "reject_reason", *order).unionByName(
        copies.select("url", "reject_reason", *order)
    )


def split_duplicates(
    judged: DataFrame, order: list[str] = ORDER
) -> tuple[DataFrame, DataFrame]:
    """Good documents, first one per URL, and every other record with its reason.

    ``judged`` is read several times and should be a written table.
    """
    good = judged.where(F.col("reject_reason").isNull())
    first = unique_url(good.select("url", *order), order)
    return unique_url(good, order).drop("reject_reason"), set_aside(judged, first, order)

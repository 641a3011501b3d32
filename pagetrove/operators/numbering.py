"""Dense, ordered numbering without a single-task window over the rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def number_rows(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Add ``_number``: first, first+1, ... in the order of the given columns.

    Rows are range-partitioned and sorted once and written to the shared folder,
    which pins which row is where. Each partition then needs only the count of
    the rows before it. ``order`` must identify a row.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(
        sorted_rows.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_place"),
        ),
        "numbered",
    )
    # One row per partition of the sort: the window and the broadcast stay small.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = F.col("_place") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + inside + F.lit(first)).alias("_number")
    )


def assign_id(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Add ``id``, growing by one per row in arrival order."""
    return number_rows(df, order, first).withColumnRenamed("_number", "id")

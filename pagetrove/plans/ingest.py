"""Feed lines to stored documents."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.dedup import unique_url
from ..operators.numbering import assign_id
from ..operators.quarantine import judge, set_aside
from ..schemas import ORDER
from ..session import settle
from ..sources.store import (
    BATCH,
    FILE_ROWS,
    RUN,
    append_store,
    create_store,
    is_batch,
    next_id,
    not_stored,
    read_store,
    to_stored_doc,
)


# Columns of a judged record that only stored ones need.
TEXTS = ["author", "content", "content_text", "description", "published_date", "title"]


class IngestError(Exception):
    """Bad records in a feed that must hold none."""


class IngestResult(NamedTuple):
    stored: DataFrame
    rejects: DataFrame


def ingest(
    lines: DataFrame,
    store_path: str,
    batch: int,
    order: list[str] = ORDER,
    on_error: str = "quarantine",
    run: str = "batch",
    file_rows: int = FILE_ROWS,
) -> IngestResult:
    """Store the good documents of a feed as one batch; first URL wins.

    Pages are parsed once, row by row, and written without their HTML. Every record that the store is
    asked to take gets the next id in arrival order, whether it is taken or refused as over-long or a copy,
    so refused ones leave gaps. All later steps read that numbered table. A batch that is run again
    replaces itself; batches of another ``run`` are left alone, whatever their number.

    ``on_error="fail"`` raises instead of setting bad records aside. Pages
    without a title or headings are skipped in either case.
    """
    if on_error not in ("quarantine", "fail"):
        raise ValueError(f"on_error: {on_error}")
    spark = lines.sparkSession
    create_store(spark, store_path)
    good, refused = F.col("reject_reason").isNull(), F.col("reject_reason").startswith("too_long:")
    counted = Observation()
    # What is not stored is known by its place and reason from here on; its texts, often the longest, are not written.
    judged = judge(lines).observe(counted, F.count_if(good | refused).alias("attempts"))
    judged = settle(judged.withColumns({c: F.when(good, F.col(c)) for c in TEXTS}), "judged")
    number, first = counted.get["attempts"], next_id(spark, store_path, run, batch)
    attempts = assign_id(judged.where(good | refused), order, first)
    taken = attempts.where(good)
    # Read several times from here on; each reading would repeat the joins behind it.
    fresh = settle(
        not_stored(spark, store_path, unique_url(taken, ["id"]), taken.select("url"), number, ~is_batch(run, batch)), "fresh")
    rejects = settle(set_aside(judged, fresh, order), "rejects")
    if on_error == "fail":
        counts = rejects.where(F.col("reject_reason") != "invalid").groupBy("reject_reason").count()
        faults = {r["reject_reason"]: r["count"] for r in counts.collect()}
        if faults:
            raise IngestError(f"bad records: {faults}")
    append_store(to_stored_doc(fresh), store_path, run, batch, first + number - 1, file_rows)
    stored = read_store(spark, store_path).where(is_batch(run, batch)).drop(RUN, BATCH)
    return IngestResult(stored, rejects)

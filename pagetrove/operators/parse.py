"""Raw pages to documents, and the checks a document must pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import (
    html_div_content,
    html_headings,
    html_meta,
    html_published_date,
    html_title,
    meta_tags,
    strip_invisible,
)
from ..functions.patterns import array_to_text
from ..schemas import LIMITS


# Each field from the visible HTML and its meta tags.
FIELDS = {
    "author": lambda html, metas: html_meta(metas, "author"),
    "content": lambda html, metas: html_headings(html),
    "description": lambda html, metas: html_meta(metas, "description"),
    "published_date": lambda html, metas: html_published_date(html),
    "title": lambda html, metas: html_title(html),
}

# Only extracted when named; nothing that is stored reads it.
MORE_FIELDS = {"body_text": lambda html, metas: html_div_content(html)}


def parse_pages(pages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Document fields of each page; columns other than ``content`` are kept.

    Only headings are cleaned; title, description, author and date stay raw.

    The fields leave through a one-row generator. A later filter on them then
    stays above it, where the optimizer would otherwise copy the extraction into
    the filter and run it twice. Name the ``fields`` wanted if not all are.
    """
    kept = [c for c in pages.columns if c != "content"]
    html, metas = F.col("_html"), F.col("_metas")
    wanted = list(FIELDS) if fields is None else fields
    row = F.struct(*[(FIELDS | MORE_FIELDS)[f](html, metas).alias(f) for f in wanted])
    visible = pages.withColumn("_html", strip_invisible(F.col("content")))
    return visible.withColumn("_metas", meta_tags(html)).select(*kept, F.inline(F.array(row)))


def with_content_text(docs: DataFrame) -> DataFrame:
    """Add ``content_text``, the heading list as it is stored and searched."""
    return docs.withColumn("content_text", array_to_text(F.col("content")))


def is_valid() -> Column:
    """URL, headings and title are present. An empty string is present."""
    return F.col("url").isNotNull() & F.col("content").isNotNull() & F.col("title").isNotNull()


def overlong(column: str) -> Column:
    """Longer than its limit by more than trailing spaces."""
    limit = LIMITS[column]
    value = F.col(column)
    tail = F.substr(value, F.lit(limit + 1))
    return F.coalesce((F.length(value) > limit) & (F.rtrim(tail) != ""), F.lit(False))


def fit_columns(docs: DataFrame) -> DataFrame:
    """Cut the surplus trailing spaces that a length limit forgives; overlong values stay whole."""
    return docs.withColumns(
        {c: F.when(overlong(c), F.col(c)).otherwise(F.left(F.col(c), F.lit(n))) for c, n in LIMITS.items()}
    )


def too_long() -> Column:
    """``too_long:<column>`` of the first column over its limit, else null."""
    return F.coalesce(*[F.when(overlong(c), F.lit(f"too_long:{c}")) for c in LIMITS])

"""Search patterns and the text form in which heading lists are searched."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_pattern(query: str) -> str:
    """``%query%``; ``%`` and ``_`` in the query stay wildcards.

    A backslash before any other character stands for that character alone.
    Spark refuses such a pattern, so the backslash is left out.
    """
    return re.sub(
        r"(?s)\\(.)",
        lambda m: m.group(0) if m.group(1) in "\\%_" else m.group(1),
        f"%{query}%",
    )


def ilike_any(pattern: str, *columns: str) -> Column:
    """True if any column matches; a null column decides nothing."""
    condition = F.col(columns[0]).ilike(pattern)
    for name in columns[1:]:
        condition = condition | F.col(name).ilike(pattern)
    return condition


def array_to_text(items: Column) -> Column:
    """SQL array text such as ``{"two words",one}``.

    Enough quoting for cleaned headings, which hold word characters and single
    spaces only.
    """
    quoted = F.transform(
        items,
        lambda x: F.when(
            F.contains(x, F.lit(" ")) | (F.lower(x) == "null"),
            F.concat(F.lit('"'), x, F.lit('"')),
        ).otherwise(x),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))

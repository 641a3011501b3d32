"""Words, lines and text digests as column expressions.

A word is a run of characters other than the space and U+0009 to U+000D.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order; a null text has none."""
    return F.filter(F.split(or_empty(text), SPACES), lambda w: w != "")


def pin(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and ``value`` as a column that later expressions read and do not compute again.

    The one-row generator above the projection is a barrier: the optimizer does not merge
    projections across it, so a lambda that reads the column does not run its expression once
    per element.
    """
    return df.select(*keep, value.alias("_v")).select(*keep, F.explode(F.array("_v")).alias(name))

"""Character trigrams of texts and of search patterns.

A text that matches a pattern holds every trigram of the pattern's literal parts, so trigrams rule texts out
before the pattern is tried. Both sides are in lower case, as a case-insensitive match compares them.
"""

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Places of a signature; a word holds 64 of them.
PLACES = 1 << 18


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; null without a text."""
    # One pass: a capture looks ahead from every character.
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1)))


def gram_place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PLACES))


def literal_parts(pattern: str) -> list[str]:
    """What a LIKE pattern wants word for word: the runs between its wildcards, escapes resolved."""
    runs, run = [], ""
    for token in re.findall(r"(?s)\\.|.", pattern):
        if token in ("%", "_"):
            runs.append(run)
            run = ""
        else:
            run += token[-1]
    return [r for r in [*runs, run] if r]


def pattern_places(spark: SparkSession, pattern: str) -> list[int]:
    """Places of all trigrams that a match must hold; none for patterns of short parts only."""
    parts = literal_parts(pattern)
    if not parts:
        return []
    # By the same functions as texts, on constants: no job runs.
    held = F.flatten(F.array(*[grams(F.lit(p)) for p in parts]))
    row = spark.range(1).select(F.transform(F.array_distinct(held), gram_place)).first()
    return sorted(set(row[0]))

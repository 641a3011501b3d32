"""Text cleaning: punctuation, digits, case, stop-words.

The steps are separate so each can be used alone; ``clean_text`` runs them with
the two delete passes folded into one regular expression.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, for use inside a character class.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"

# The stop-word list.
STOPWORDS = [
    "the", "is", "in", "and", "to", "a", "of", "for", "on", "with", "this", "that", "it", "are",
    "as", "at", "by", "an", "be", "but", "not", "or", "from", "all", "if", "which", "when",
    "you", "your", "they", "their", "my", "he", "she", "there", "what", "so", "we", "us", "his",
    "her", "its", "can", "will", "would", "should",
]


def strip_punct(text: Column) -> Column:
    """Delete (not blank out) everything but letters, numbers, ``_`` and space."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{SPACE}]+", "")


def strip_digits(text: Column) -> Column:
    """Delete decimal digits of any script; superscripts and fractions stay."""
    return F.regexp_replace(text, r"\p{Nd}+", "")


def split_words(text: Column) -> Column:
    """Words between runs of white space. May hold empty strings at the ends."""
    return F.split(text, f"[{SPACE}]+")


def remove_stopwords(words: Column) -> Column:
    """Drop stop-words and empty strings, keep order and repeats."""
    dropped = ", ".join(f"'{w}'" for w in ["", *STOPWORDS])
    return F.call_function("filter", words, F.expr(f"w -> w NOT IN ({dropped})"))


def null_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_words(text: Column) -> Column:
    """Cleaned text, empty when nothing is left.

    Punctuation and digits go in one pass: a digit is dropped whether or not its
    neighbours are, so the two passes commute. Only then are words compared with
    the stop list.
    """
    kept = F.regexp_replace(text, rf"[^\p{{L}}\p{{Nl}}\p{{No}}_{SPACE}]+", "")
    return F.array_join(remove_stopwords(split_words(F.lower(kept))), " ")


def clean_text(text: Column) -> Column:
    """Cleaned text, or null when nothing is left."""
    return null_if_blank(clean_words(text))

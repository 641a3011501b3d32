"""Quality rules: one projection over a threshold table.

Base measures and two base rules are fixed; ``RULES`` holds the further thresholds, each a
ratio with bounds. Null text: no words, so the document fails the base rules. Empty and
one-word texts fail them too. Rows are judged one by one: repeated rows, ties and null ids get
the same verdict, an empty table gives an empty result. Columns of the input with the name of
a measure are left out of ``measure`` and untouched in ``keep_good``.

Windows found twice are counted without grouping rows: each window of a text becomes one
long, upper bits a hash and lower bits its place, the longs are sorted, and only windows whose
upper bits meet a neighbour's are compared word by word.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WORD, or_empty, pin, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
PLACE_BITS = 31

# Common words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it",
    "le", "la", "de", "des", "et", "les", "un", "que",
    "der", "die", "das", "und", "ist", "den", "zu", "mit",
    "el", "los", "del", "y", "en", "por", "las", "es",
]


class Rule(NamedTuple):
    """``part`` over ``whole`` within [low, high]; null is no bound. A whole of zero passes."""

    name: str
    part: str
    whole: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("lines_with_end_mark", "n_end_marks", "n_lines", 0.10, None),
    Rule("capitals", "n_capitals", "word_chars", None, 0.50),
    Rule("letters", "n_letters", "word_chars", 0.60, None),
)

END_MARK = "[.!?:;…\"”»)。][\\x20\\x09\\x0B-\\x0D]*(?:\n|$)"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _stop_pattern() -> str:
    """Stop words in lower case after white space and before white space or a mark, by first letter."""
    tails: dict[str, list[str]] = {}
    for word in STOP_WORDS:
        tails.setdefault(word[0], []).append(word[1:])
    heads = "|".join(f"{head}(?:{'|'.join(ends)})" for head, ends in tails.items())
    return f"[\\x20\\x09-\\x0D](?:{heads})(?=[\\x20\\x09-\\x0D.,;:!?])"


def _sortable(words: Column) -> Column:
    """One long per window: hash above, place below."""
    place = F.sequence(F.lit(0), F.size(words) - WINDOW)
    low = (1 << PLACE_BITS) - 1
    keys = F.transform(
        place,
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
        .bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
    )
    none = F.array().cast("array<bigint>")
    return F.sort_array(F.when(F.size(words) >= WINDOW, keys).otherwise(none))


def _suspects(keys: Column) -> Column:
    """Places of windows whose hash meets that of a neighbour in sorted order."""
    def meets(key: Column, other: Column) -> Column:
        return F.coalesce(F.shiftright(key.bitwiseXOR(other), PLACE_BITS) == 0, F.lit(False))

    near = F.filter(keys, lambda k, i: meets(k, F.get(keys, i - 1)) | meets(k, F.get(keys, i + 1)))
    return F.transform(near, lambda k: k.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))


def _windows(words: Column, places: Column) -> Column:
    """Word triples with their places, sorted so that equal ones are neighbours."""
    return F.sort_array(F.transform(
        places,
        lambda p: F.struct(*[F.get(words, p + k).alias(f"w{k}") for k in range(WINDOW)], p.alias("p")),
    ))


def _covered(windows: Column) -> Column:
    """Number of words in windows that equal a neighbour."""
    def same(a: Column, b: Column) -> Column:
        equal = F.lit(True)
        for k in range(WINDOW):
            equal = equal & (a[f"w{k}"] == b[f"w{k}"])
        return F.coalesce(equal, F.lit(False))

    twice = F.filter(
        windows, lambda w, i: same(w, F.get(windows, i - 1)) | same(w, F.get(windows, i + 1))
    )
    places = F.flatten(F.transform(twice, lambda w: F.array(*[w["p"] + k for k in range(WINDOW)])))
    return F.size(F.array_distinct(places)).cast("long")


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with the base measures and all that ``RULES`` needs, from column ``text``."""
    text = or_empty(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    taken = docs.select(*keep, text.alias("text"))
    split = pin(taken, "s", F.struct(
        words_of(F.col("text")).alias("words"), lines.alias("lines"), F.col("text").alias("text")
    ), *keep)
    keyed = pin(split, "k", F.struct("s.*", _sortable(F.col("s.words")).alias("keys")), *keep)
    placed = pin(keyed, "p", F.struct(
        "k.words", "k.lines", "k.text",
        _windows(F.col("k.words"), _suspects(F.col("k.keys"))).alias("windows"),
    ), *keep)
    words, lines, text = F.col("p.words"), F.col("p.lines"), F.col("p.text")

    def left(chars: Column) -> Column:
        return F.length(chars).cast("long")

    return placed.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        left(F.array_join(words, "")).alias("word_chars"),
        left(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col("p.windows")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(_stop_pattern())).cast("long").alias("n_stop_words"),
        F.regexp_count(text, F.lit(END_MARK)).cast("long").alias("n_end_marks"),
        left(F.regexp_replace(text, "\\P{Lu}+", "")).alias("n_capitals"),
        left(F.regexp_replace(text, "\\P{L}+", "")).alias("n_letters"),
    )


def _passes(rule: Rule) -> Column:
    ratio = F.try_divide(F.col(rule.part).cast("double"), F.col(rule.whole).cast("double"))
    within = F.lit(True)
    if rule.low is not None:
        within = within & (ratio >= rule.low)
    if rule.high is not None:
        within = within & (ratio <= rule.high)
    return F.coalesce(within, F.lit(True))


def verdict(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and ``failed``, the names of the rules that fail."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    failed = F.filter(
        F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda name: name.isNotNull()
    )
    return measured.withColumn("base_failed", base_failed).withColumn("failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, all columns as they were."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return verdict(measure(whole, "_row"), rules).where("kept").select("_row.*")

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetrove.functions import text as T

GOLDEN = [
    ("The Quick, Brown Fox!", "quick brown fox"),
    ("Don't panic", "dont panic"),
    ("state-of-the-art", "stateoftheart"),
    ("snake_case v2", "snake_case v"),
    ("Top 10 C++ Tips", "top c tips"),
    ("1a2the3", "athe"),
    ("THE and 42!!!", None),
    ("...", None),
    (None, None),
    ("  a\u00a0b\tc ", "b c"),
    ("Été À Paris", "été à paris"),
    ("e\u0301a", "ea"),
    ("x²y", "x²y"),
    ("\u0130stanbul", "i\u0307stanbul"),
    ("ΟΔΟΣ", "οδος"),
]


def plain_clean(text):
    """The same rules restated with Python's own Unicode classes."""
    kept = "".join(c for c in text if c.isalnum() or c == "_" or c.isspace())
    kept = "".join(c for c in kept if not c.isdecimal()).lower()
    left = [w for w in kept.split() if w not in set(T.STOPWORDS)]
    return " ".join(left) or None


def run(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", column(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_golden(spark):
    assert run(spark, T.clean_text, [g[0] for g in GOLDEN]) == [g[1] for g in GOLDEN]


def test_stopwords_are_46_and_distinct():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 46


def test_steps(spark):
    assert run(spark, T.strip_punct, ["a-b_c 1!", "x’y"]) == ["ab_c 1", "xy"]
    assert run(spark, T.strip_digits, ["a1b٣c²"]) == ["abc²"]


def test_folded_passes_equal_separate_passes(spark):
    texts = ["1,2-3", "a1.b2", "٣-x", "Ⅷ ½ ²", "the1 the"]
    separate = run(
        spark,
        lambda c: T.null_if_blank(
            F.array_join(
                T.remove_stopwords(T.split_words(F.lower(T.strip_digits(T.strip_punct(c))))), " "
            )
        ),
        texts,
    )
    assert run(spark, T.clean_text, texts) == separate


def test_every_assigned_code_point(spark):
    def known_to_both(c):
        # Unicode 13 is what Java 17 knows; later additions read as unassigned there.
        return unicodedata.category(c) not in ("Cn", "Cs")

    chars = [chr(i) for i in range(1, 0x20000) if known_to_both(chr(i))]
    got = run(spark, lambda c: F.concat(F.lit("<"), F.coalesce(T.clean_text(c), F.lit("")), F.lit(">")),
              [f"x{c}y" for c in chars])
    wrong = [c for c, g in zip(chars, got) if g != f"<{plain_clean(f'x{c}y') or ''}>"]
    java_unassigned = spark.createDataFrame([(c,) for c in wrong] or [("a",)], "c string")
    still = [
        r.c
        for r in java_unassigned.where(~F.col("c").rlike(r"^\p{Cn}$")).collect()
        if r.c in wrong
    ]
    assert still == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60), min_size=1, max_size=40))
def test_matches_plain_python(spark, texts):
    assert run(spark, T.clean_text, texts) == [plain_clean(t) for t in texts]


def test_output_properties(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs.select(T.clean_text(F.col("text")).alias("c")).where("c is not null")
    bad = out.where(
        F.col("c").rlike(r"\p{Nd}|  |^ | $")
        | F.arrays_overlap(F.split("c", " "), F.array(*[F.lit(w) for w in T.STOPWORDS]))
    )
    assert out.count() > 0 and bad.count() == 0


@pytest.mark.parametrize("text", ["THE", "the1", "1the"])
def test_digits_go_before_stopwords(spark, text):
    assert run(spark, T.clean_text, [text]) == [None]


def test_plain_restatement_matches_golden():
    assert [plain_clean(g[0]) for g in GOLDEN if g[0] is not None] == [
        g[1] for g in GOLDEN if g[0] is not None
    ]
    assert re.fullmatch(r"[a-z]+", "".join(T.STOPWORDS))

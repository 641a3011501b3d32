import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetrove.operators.seen import glob_to_regex, micros, seen_lookup, seen_within_ttl


def replay(rows, ttl):
    out, last = set(), {}
    for key, t, i in sorted(rows):
        if key not in last or t >= last[key] + ttl:
            last[key] = t
            out.add((key, t, i))
    return out


def run(spark, rows, ttl, fold_rows=10_000, chunk_rows=4_096):
    df = spark.createDataFrame(rows, "key string, t long, id long")
    emitted = seen_within_ttl(df, ttl, fold_rows, chunk_rows).select("key", "t", "id")
    got = [tuple(r) for r in emitted.collect()]
    assert len(got) == len(set(got))
    return set(got)


# One array per key; arrays of chunks; pairs of chunks down to single slices.
WAYS = [(10_000, 4_096), (0, 4_096), (0, 24), (0, 0)]


@pytest.mark.parametrize("fold_rows,chunk_rows", WAYS[:2])
def test_suppressed_sightings_do_not_restart_the_clock(spark, fold_rows, chunk_rows):
    rows = [("u", t, t) for t in (0, 300, 599, 600, 900, 1200)]
    assert {r[1] for r in run(spark, rows, 600, fold_rows, chunk_rows)} == {0, 600, 1200}


@pytest.mark.parametrize("fold_rows,chunk_rows", WAYS)
def test_every_way_equals_replay(spark, fold_rows, chunk_rows):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.randrange(-300, 500), i) for i in range(250)]
    # A quiet stretch, so that some chunks are missing.
    rows = [r for r in rows if not 100 < r[1] < 260]
    assert run(spark, rows, 53, fold_rows, chunk_rows) == replay(rows, 53)


def test_a_hot_key_within_one_ttl_is_never_an_array(spark, monkeypatch):
    from pagetrove.operators import seen

    plans = []

    def settle(df, name, keep=seen.settle):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(seen, "settle", settle)
    rows = [("hot", t, t) for t in range(0, 10_000, 2)]
    for ttl in (20_000, 5_000):
        assert run(spark, rows, ttl, 64, 64) == replay(rows, ttl)
    assert plans and not any("collect_list" in p for p in plans)


def test_only_heavy_keys_take_the_distributed_way(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(5_000), i) for i in range(900)]
    rows += [(f"k{i % 40}", rng.randrange(5_000), 1_000 + i) for i in range(200)]
    assert run(spark, rows, 60, 100, 64) == replay(rows, 60)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 120), st.integers(0, 999)), min_size=1, max_size=80),
    st.integers(1, 30),
    st.sampled_from([8, 30, 4_096]),
)
def test_distributed_way_property(spark, rows, ttl, chunk_rows):
    assert run(spark, rows, ttl, 0, chunk_rows) == replay(rows, ttl)


def test_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("key"), micros(F.col("ts")).alias("t"), F.col("event_id").alias("id"))
    ttl = 6 * 3_600_000_000
    got = {tuple(r) for r in seen_within_ttl(rows, ttl).select("key", "t", "id").collect()}
    assert got == replay([tuple(r) for r in rows.collect()], ttl)


def test_glob(spark):
    import re

    cases = [
        ("http://a/*", "http://a/b", True),
        ("http://a/?", "http://a/bc", False),
        ("a[bc]d", "acd", True),
        ("a[^bc]d", "acd", False),
        ("a[b-d]e", "ace", True),
        (r"a\*", "a*", True),
        (r"a\*", "ab", False),
        ("a.c", "abc", False),
        ("[", "[", True),
    ]
    for glob, text, want in cases:
        assert bool(re.match(glob_to_regex(glob).replace(r"\z", r"\Z"), text)) == want, glob
    df = spark.createDataFrame([(c[1],) for c in cases], "url string")
    assert {r.url for r in seen_lookup(df, "a[bc]*").collect()} == {"acd", "ace", "ab", "abc"}

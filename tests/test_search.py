import json

import pytest

from pagetrove.functions.patterns import make_pattern
from pagetrove.operators import search as S
from pagetrove.schemas import STORED_DOC

ROWS = [
    (1, None, "{x}", None, None, "A b", "u1"),
    (2, None, '{"q r"}', "has a", None, "zz", "u2"),
    (3, None, "{q}", None, None, "zz", "u3"),
    (4, None, '{"one two",three}', None, None, "100%", "u4"),
]

CASES = [
    ("a", [1, 2]),
    ("Q", [2, 3]),
    ("q r", [2]),
    ("two three", []),
    ("{", [1, 2, 3, 4]),
    ("z_", [2, 3]),
    ("%", [1, 2, 3, 4]),
    ("", []),
    (None, []),
    (" ", [1, 2, 4]),
    (r"100\%", [4]),
    (r"\o\n\e", [4]),
    ("100%\\", [4]),
    ("'", []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, STORED_DOC).cache()


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("query,want", CASES)
def test_search(docs, query, want):
    assert ids(S.search(docs, query)) == want
    assert ids(S.search_sql(docs, query)) == want
    assert sorted(ids(S.search(docs, query, ordered=False))) == want


@pytest.mark.parametrize("per_pass", [64, 3])
def test_many_equal_one_by_one(docs, monkeypatch, per_pass):
    monkeypatch.setattr(S, "QUERIES_PER_PASS", per_pass)
    got = {}
    for r in S.search_many(docs, [q for q, _ in CASES] + ["a"]).collect():
        got.setdefault(r.q, []).append(r.id)
    assert {q: sorted(v) for q, v in got.items()} == {q: w for q, w in CASES if w}
    assert S.search_many(docs, ["", None]).count() == 0


def test_limit_is_per_query_and_lowest_ids(spark):
    many = spark.createDataFrame([(i, None, "{x}", None, None, "t", f"u{i}") for i in range(50, 0, -1)], STORED_DOC)
    assert ids(S.search(many, "t")) == list(range(1, 21))
    assert sorted(ids(S.search_many(many, ["t"]))) == list(range(1, 21))


def test_many_keeps_few_rows_before_the_shuffle(docs):
    plan = S.search_many(docs, ["a", "%"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_display_and_json(docs):
    shown = S.display(S.search(docs, "a")).collect()
    assert [tuple(r) for r in shown] == [(0, "u1", "A b", None), (1, "u2", "zz", "has a")]
    answer = json.loads(S.result_json(S.search(docs, "a"), "a").first().json)
    assert answer["results"]["defaultQuery"] == "a"
    assert [s["id"] for s in answer["results"]["sites"]] == [1, 2]
    assert list(answer["results"]["sites"][0]) == STORED_DOC.names
    assert json.loads(S.result_json(S.search(docs, "nope"), "nope").first().json)["results"]["sites"] == []
    assert json.loads(S.result_json(S.search(docs, ""), "").first().json) == {"results": []}


def test_patterns():
    assert make_pattern("a") == "%a%"
    assert make_pattern("\\x\\\\\\_") == "%x\\\\\\_%"
    assert make_pattern("\\") == "%\\%"

import math
import re
from collections import Counter

import pytest

from pagetrove.llm import queries, ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    """(item, rank, doc, score) by the formula, document by document; docs and items are lists of pairs."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, c in counted:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc, score))
        scored.sort(key=lambda r: r[:3])
        out += [(item, k, r[3], r[4]) for k, r in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(spark, pairs):
    return spark.createDataFrame(pairs, "item_id long, text string")


@pytest.fixture(params=["one group", "many groups"])
def groups(request, monkeypatch):
    if request.param == "many groups":
        monkeypatch.setattr(ranking, "GROUP_BYTES", 2_000)
        monkeypatch.setattr(ranking, "CELLS", 50)


def test_query_equals_brute_force(spark, sf_dir, groups):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = queries.op13_ranking(spark, sf_dir)
    assert dict(rows.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert got(rows) == brute(docs, items)


def test_edges(spark, documents, groups):
    long = "needle " + "hay É9 " * 60_000
    docs = [(4, "The cat. THE-CAT! catalogue"), (2, "the cat the cat"), (3, "the cat the cat"), (3, "the cat the cat"),
            (None, "the cat the cat"), (5, None), (6, ""), (7, "?! \t"), (8, long), (9, "É é x\x00y café 日本語 日本")]
    items = [(1, "cat"), (2, "CAT, the cat"), (3, None), (4, "..."), (5, "É é"), (6, "日本語"), (7, "x y z"),
             (8, "needle hay"), (None, "cat É"), (9, "absent"), (10, "cat"), (10, "hay")]
    extra = documents(docs).withColumnRenamed("lang", "_item").withColumnRenamed("source", "score")
    assert got(ranking.rank(extra, items_of(spark, items))) == brute(docs, items)
    assert got(ranking.rank(extra, items_of(spark, items), top=2)) == brute(docs, items, 2)


def test_empty_tables(spark, documents):
    item = items_of(spark, [(1, "a")])
    for docs, items in (([], item), ([(1, None)], item), ([(1, "a")], items_of(spark, []))):
        frame = ranking.rank(documents(docs), items)
        assert frame.columns == ["item_id", "rank", "doc_id", "score"] and frame.count() == 0


def test_many_ties_keep_the_smallest_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 64)
    docs = [((i * 37) % 2003, "alpha beta" if i % 3 else "alpha gamma") for i in range(2003)]
    items = [(1, "alpha"), (2, "gamma delta"), (3, "beta alpha")]
    frame = documents(docs).repartition(7)
    assert got(ranking.rank(frame, items_of(spark, items))) == brute(docs, items)


def test_hits_respect_boundaries():
    automaton = ranking.build([b"a", b"ab", b"b"])
    n, found = ranking.count_terms(automaton, "a a ab,B b-a aab")
    assert n == 7 and found == {0: 3, 1: 1, 2: 2}

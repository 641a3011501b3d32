import re
from collections import Counter

from pagetrove.llm import quality, queries

SPACE = " \t\n\x0b\x0c\r"


def measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def base_failed(n_words, *rest):
    return n_words < 50 or 100 * rest[-1] > 50 * n_words


def test_query_equals_brute_force_and_labels(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    lost = []
    for row in rows:
        want = measures(texts[row.doc_id])
        assert tuple(row[c] for c in quality.BASE) == want
        assert row.base_failed == base_failed(*want)
        assert not (row.base_failed and row.kept)
        if row.base_failed is False and row.doc_id in labels:
            lost.append(row.kept == bool(labels[row.doc_id]))
    assert sum(lost) >= 0.98 * len(lost)


def test_edges(spark, documents):
    prose = " ".join(f"word{i} the" for i in range(40)) + "."
    texts = [
        None, "", " \t\n ", "one", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "#*$%&|<> \x0b\x0cé",
        "né   b c", prose, prose + "\n" + prose, "b c " * 3000, "w " + "v" * 100_000,
        " ".join(str(i) for i in range(20_000)) + " 0 1 2",
    ]
    docs = documents(list(enumerate(texts)) + [(None, "a b c"), (3, "one")])
    rows = quality.measure(docs, "doc_id").collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        if row.doc_id is not None:
            assert tuple(row[c] for c in quality.BASE) == measures(texts[row.doc_id]), row.doc_id
    clash = docs.withColumnRenamed("n_chars", "n_words").withColumnRenamed("source", "s")
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns
    assert [r.doc_id for r in kept.collect()] == [10]
    assert quality.keep_good(documents([])).count() == 0

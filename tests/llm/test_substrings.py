import hashlib
import random
import re

import pytest

from pagetrove.llm import queries, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(rows, width=50):
    """rows: (doc_id, text) -> list of (n_words, n_removed, digest)."""
    first, split = {}, [WORD.findall(t or "") for _, t in rows]
    for (key, _), words in zip(rows, split):
        if key is not None:
            for p in range(len(words) - width + 1):
                gram = tuple(words[p : p + width])
                first[gram] = min(first.get(gram, key), key)
    out = []
    for (key, _), words in zip(rows, split):
        gone = set()
        for p in range(len(words) - width + 1) if key is not None else ():
            if first[tuple(words[p : p + width])] < key:
                gone.update(range(p, p + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {key: e for (key, _), e in zip(rows, expected(rows))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substrings(spark, sf_dir).collect()}
    assert got == want
    assert sum(e[1] for e in want.values()) > 0


def corpus(seed):
    chance = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]

    def words(n):
        return [chance.choice(vocabulary) for _ in range(n)]

    shared = [words(chance.choice([20, 49, 50, 51, 70, 130])) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = words(chance.randint(0, 60))
        for _ in range(chance.randint(0, 3)):
            passage = list(chance.choice(shared))
            a = chance.randint(0, 5)
            if chance.random() < 0.3:
                passage[chance.randrange(len(passage))] = "edit"
            parts += passage[a:] + words(chance.choice([0, 1, 30]))
        texts.append(chance.choice([" ", "  ", "\n"]).join(parts))
    texts += [texts[3], texts[5], "a " * 200, "a " * 120, "a b " * 60, "", None, " \t", "one"]
    ids = list(range(len(texts)))
    chance.shuffle(ids)
    return list(zip(ids, texts)) + [(None, texts[0]), (ids[0], texts[0]), (ids[1], texts[2] + " " + texts[4])]


@pytest.mark.parametrize("seed, cell_words", [(1, 20_000), (2, 60)])
def test_random_corpora(spark, documents, monkeypatch, seed, cell_words):
    monkeypatch.setattr(substrings, "CELL_WORDS", cell_words)
    pairs = corpus(seed)
    docs = documents(pairs).withColumnRenamed("lang", "h").withColumnRenamed("source", "owner")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs).collect()]
    want = [(key, *e) for (key, _), e in zip(pairs, expected(pairs))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = substrings.remove(docs)
    assert left.columns == docs.columns
    texts = sorted((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest())
                   for r in left.collect() if r.doc_id is not None)
    assert texts == sorted((key, e[2]) for (key, _), e in zip(pairs, expected(pairs)) if key is not None)


def test_empty(documents):
    assert substrings.digest(documents([])).count() == 0
    assert substrings.remove(documents([])).count() == 0

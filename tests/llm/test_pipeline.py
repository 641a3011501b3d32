import random
import re

import test_packing
import test_quality
import test_secrets
import test_simhash
import test_substrings

import __spark_entry__ as entry_module
import corpus_pipeline
from pagetrove.llm import quality

SECRET = "password=7602ad27cf5550de1c"


def corpus():
    chance = random.Random(11)
    vocabulary = [f"term{i}" for i in range(400)] + ["the", "of", "and", "is"] * 30

    def prose(n):
        return " ".join(chance.choice(vocabulary) for _ in range(n))

    passage, texts = prose(80), [prose(chance.randint(60, 300)) + "." for _ in range(60)]
    texts[7] += " " + passage + "."
    texts[9] = passage + " " + texts[9]
    texts[21] += "\n" + passage + ". "
    texts[12] += f" {SECRET} end."
    texts += [texts[4], texts[4], texts[5].replace(".", " ."), None, "", "short", "### $$$ " * 60, "a b c " * 60]
    return list(enumerate(texts))


def test_stages_against_brute_force(spark, documents, sf_dir):
    docs = documents(corpus())
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "substring dedup", "secret scans", "best-fit packing"]
    rows = dict(corpus())
    verdicts = quality.verdict(quality.measure(docs, "doc_id")).collect()
    for r in verdicts:
        assert r.base_failed == test_quality.base_failed(*test_quality.measures(rows[r.doc_id]))
    rows = {r.doc_id: rows[r.doc_id] for r in verdicts if r.kept}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert kept[0] == rows and 59 in rows and len(rows) >= 60
    group = test_simhash.components({k: test_simhash.fingerprint(t) for k, t in rows.items()})
    rows = {k: t for k, t in rows.items() if group[k] == k}
    assert kept[1] == rows and not {60, 61} & set(rows)
    pairs = sorted(rows.items())
    want = {k: e for (k, _), e in zip(pairs, test_substrings.expected(pairs))}
    assert want[9][1] >= 79 and want[21][1] >= 79
    got = {k: len(test_substrings.WORD.findall(t)) for k, t in kept[2].items()}
    assert got == {k: e[0] - e[1] for k, e in want.items()}
    spans = {k: test_secrets.expected(t) for k, t in kept[2].items()}
    assert [k for k, s in spans.items() if s] == [12]
    assert kept[3] == {k: t.replace(SECRET, "[REDACTED]") for k, t in kept[2].items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    n, total = test_packing.check(packed, kept[3], 2048)
    assert n <= -(-total // 2048) + 1


def test_empty_table(spark, documents, sf_dir):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_registered(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    rows = entry_module.queries()["pipeline"](spark, sf_dir).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_operators_are_registered():
    ops = {re.match(r"op(\d+)_", name)[1] for name in entry_module.queries() if name.startswith("op")}
    assert ops == {str(n) for n in range(1, 14)}

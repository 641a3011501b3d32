import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagetrove.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity):
    sequences, documents = defaultdict(list), defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
        documents[row.doc_id].append(row)
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    for key, text in texts.items():
        ids = ids_of(text)
        own = sorted(documents[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    return len(sequences), sum(r.length for r in rows)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, total = check(queries.op7_packing(spark, sf_dir).collect(), texts, 2048)
    assert n <= -(-total // 2048) + 1


@pytest.mark.parametrize("chunk_rows", [50_000, 3])
def test_nulls_ties_and_long_texts(spark, documents, monkeypatch, chunk_rows):
    monkeypatch.setattr(packing, "CHUNK_ROWS", chunk_rows)
    texts = {i: "word " * (i % 40) for i in range(300)}
    texts |= {900: None, 901: "", 902: "x y z " * 9000, 903: "<|endoftext|> a<|endoftext|><|endof|> b <|endoftext|>", 904: " " * 400_000 + "<|endoftext|>  x", None: "no id"}
    docs = documents(list(texts.items())).withColumnRenamed("lang", "length").withColumnRenamed("source", "_chunk")
    check(packing.pack(docs, PATH, public_tokenizers.PATTERN, 64).collect(), texts, 64)
    twice = docs.unionByName(docs.where("doc_id = 902"))
    assert packing.pack(twice, PATH, public_tokenizers.PATTERN).count() > packing.pack(
        docs, PATH, public_tokenizers.PATTERN).count()
    assert packing.pack(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_sequences_hold_the_tokens(documents):
    texts = {i: f"word {i} " * (i % 40) for i in range(120)} | {900: None, 901: "x y z é😀 " * 300}
    rows = packing.pack(documents(list(texts.items())), PATH, public_tokenizers.PATTERN, 64).collect()
    sequences, documents_ = defaultdict(list), defaultdict(list)
    for row in rows:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert len(ids) == row.length and zlib.crc32(row.ids) == row.ids_crc32
        sequences[row.sequence_id].append((row.offset, ids))
        documents_[row.doc_id].append((row.piece, ids))
    for key, text in texts.items():
        assert [i for _, ids in sorted(documents_[key]) for i in ids] == ids_of(text)
    assert all(sum(len(ids) for _, ids in own) <= 64 for own in sequences.values())
    assert sum(len(ids) for own in sequences.values() for _, ids in own) == sum(len(ids_of(t)) for t in texts.values())


@pytest.mark.parametrize("seed", range(20))
def test_plan_fills_sequences(seed):
    chance = random.Random(seed)
    capacity = chance.choice([10, 64, 2048])
    counts = Counter(chance.choice([chance.randint(1, capacity), chance.randint(1, max(1, capacity // 4))])
                     for _ in range(chance.randint(1, 3000)))
    places = defaultdict(list)
    for length, low, high, sequence, per, place in packing.plan(dict(counts), capacity):
        for rank in range(low, high):
            k = rank - low
            places[sequence + k // per].append((place + k % per * length, length))
    assert Counter(length for own in places.values() for _, length in own) == counts
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    large = sum(n for length, n in counts.items() if 2 * length > capacity)
    bound = max(large, -(-sum(k * n for k, n in counts.items()) // capacity))
    assert len(places) <= 1.05 * bound + 2


def test_a_plan_does_not_grow_with_the_documents():
    few = packing.plan({n: 3 for n in range(1, 2049)}, 2048)
    many = packing.plan({n: 3_000_000 for n in range(1, 2049)}, 2048)
    assert len(many) <= 2 * len(few) + 4096

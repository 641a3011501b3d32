import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pagetrove.llm import bpe, pretokens, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    chance = random.Random(7)
    letters = "ab  \n\t\r.,'sdt1é中🙂 \x85　\x1cAß’-_​́"
    some = ["".join(chance.choices(letters, k=chance.randint(0, 50))) for _ in range(3000)]
    return some + ["", " ", "   x", "x  ", "it's  we'll 'tis", "<|endoftext|>", "a" * 20_000, "\x00 \x7f", "word " * 30_000]


def test_codec_equals_the_usual_encoder(reference):
    codec = bpe.Codec(bpe.serialise(bpe.read_ranks(PATH)), PATTERN)
    made = codec.encode_batch(texts())
    for text, ids in zip(texts(), made):
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_small_caches_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 10)
    codec = bpe.Codec(bpe.serialise(bpe.read_ranks(PATH)), PATTERN)
    for text in texts()[:300]:
        assert codec.encode_batch([text]) == [reference.encode_ordinary(text)]


def test_entries_that_merges_cannot_reach():
    vocabulary = [bytes([b]) for b in range(256)] + [b"xyz"]
    codec = bpe.Codec(bpe.serialise(vocabulary), PATTERN)
    assert codec.encode_batch(["xyz", "xyzz"]) == [[256], [120, 121, 122, 122]]


def test_query(spark, sf_dir, reference):
    rows = queries.op2_bpe(spark, sf_dir).collect()
    stored = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(stored)
    for row in rows:
        ids = reference.encode_ordinary(stored[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(stored[row.doc_id].encode()).hexdigest()


def test_round_trip_with_nulls_ties_and_clashing_columns(spark, documents):
    docs = documents([(None, None), (1, ""), (2, "née  l'été"), (2, "née  l'été"), (3, "x " * 5000)])
    docs = docs.withColumnRenamed("lang", "ids_sha256").withColumnRenamed("source", "bytes")
    coded = bpe.encode(docs, PATH, PATTERN, ["doc_id", "text"])
    back = bpe.decode(coded, PATH, ["doc_id", "text"]).collect()
    assert len(back) == 5
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back)
    assert bpe.digest(documents([]), PATH, PATTERN, ["doc_id"]).count() == 0

"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte is mapped to a printable character; a vocabulary entry becomes a piece of such
characters with the negative of its rank as score, so the best-scored merge is the one of
lowest rank. Normalisation is the identity. Every match of the split pattern is encoded
separately; ids are ranks. An entry that merges cannot reach stands for a match that equals it,
as in the usual encoder; these are found when the model is loaded. Decoding maps ids back to
bytes.

A null text is empty: no ids. Texts of any length are encoded whole, in batches of bounded row
number. Repeated rows and null ids are encoded like others; an empty table gives an empty
result. Only the columns asked for are read, so others may have any name.
"""

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import PieceEncoder
from .shipping import map_arrow, ship

UNKNOWN = "<unk>"


def byte_characters() -> list[str]:
    """A printable character per byte: itself where Latin-1 prints it, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


_MAPPED = dict(enumerate(byte_characters()))


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_MAPPED)


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file)]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


def read_json(path: str) -> list[bytes]:
    """The same of a tokenizer file whose entries are numbered in the order of their merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = {token["content"] for token in content["added_tokens"]}
    byte = {c: b for b, c in _MAPPED.items()}
    pairs = sorted((rank, name) for name, rank in content["model"]["vocab"].items() if name not in added)
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ids have gaps")
    return [bytes(byte[c] for c in name) for _, name in pairs]


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file and their ids."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def serialise(vocabulary: list[bytes]) -> bytes:
    """The sentencepiece model; the unknown piece takes the first free id."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(vocabulary):
        model.pieces.add(piece=mapped(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(vocabulary)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_proto=model)
        own = {c: bytes([b]) for b, c in _MAPPED.items()}
        size = self.pieces.get_piece_size() - 1
        names = [self.pieces.id_to_piece(i) for i in range(size)]
        self.entries = [b"".join(map(own.__getitem__, name)) for name in names]
        merged = self.pieces.encode(names, num_threads=1)
        self.unreachable = {name: [i] for i, name in enumerate(names) if merged[i] != [i]}
        self.encoder = PieceEncoder(pattern, self._encode_tokens)
        self.decimals = [str(i) for i in range(size)]

    def _encode_tokens(self, tokens: list[str]) -> list[list[int]]:
        names = [mapped(token.encode()) for token in tokens]
        merged = self.pieces.encode(names, num_threads=1)
        if not self.unreachable:
            return merged
        return [self.unreachable.get(name, ids) for name, ids in zip(names, merged)]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.encoder.encode_batch(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


_loaded: dict[str, Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    """One codec per worker process, kept from task to task."""
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(model, pattern)
    return _loaded[key]


def _run(df: DataFrame, path: str, pattern: str, keep: list[str], text: str, row, fields: str) -> DataFrame:
    """``keep`` and the fields that ``row(codec, ids)`` makes of each text."""
    spark = df.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(serialise(read_ranks(path)))
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + fields

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = codec(model.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            made = [row(loaded, ids) for ids in loaded.encode_batch(texts)]
            columns = [list(column) for column in zip(*made)]
            names = [*batch.schema.names[:-1], *[f.split()[0] for f in fields.split(", ")]]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(c) for c in columns], names=names)

    return map_arrow(df.select(*keep, text), encode, schema)


def _ids(codec: Codec, ids: list[int]) -> tuple:
    return (pa.scalar(ids, pa.list_(pa.int32())),)


def _digest(codec: Codec, ids: list[int]) -> tuple:
    decimals = ",".join(map(codec.decimals.__getitem__, ids))
    return (
        len(ids),
        hashlib.sha256(decimals.encode()).hexdigest(),
        hashlib.sha256(codec.decode(ids)).hexdigest(),
    )


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids``, the token ids of each whole text."""
    return _run(df, path, pattern, keep, text, _ids, "ids array<int>")


def digest(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the number of ids, the digest of the ids and that of the decoded bytes."""
    return _run(df, path, pattern, keep, text, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``bytes``, the inverse of ``encode``; null ids decode to nothing."""
    entries = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = entries.value
        for batch in batches:
            made = [b"".join(map(table.__getitem__, row or ())) for row in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "bytes"]
            )

    return map_arrow(df.select(*keep, ids), run, schema)

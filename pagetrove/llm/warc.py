"""WARC archives: written as one gzip stream, normalised to a member per record, read by offset.

``write`` makes archives of one gzip stream each, as crawlers leave them. ``normalise`` inflates
such a stream once, chunk by chunk, writes every record as a gzip member of its own and a sidecar index
with a JSON line (seq, type, id, offset, length) per record. ``read`` takes the sidecar and fetches
each member by its offset.

Files lie in the shared folder and are named by attempt; only those that a finished task reported are
used, so a task that runs again leaves a file that nobody reads. Pages do not move between
tasks: the decision which records become revisits is made on their digests alone.

Records of equal payloads of REVISIT_BYTES and more: the smallest page id is the response, ids that are null come
last, repeated rows of that id in order of place. Null html is an empty payload. Targets are
percent-encoded; a null url gives no target. An empty table gives an empty result. Other input
columns are not read.
"""

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, settle
from .shipping import map_arrow, ship

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
REVISIT_BYTES = 100
GZIP = 31
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "archive string, seq int, page_id long, payload_bytes long, payload_digest string"
RECORDS = (
    "archive string, seq int, record_id string, record_type string, page_id long, payload_bytes long, "
    "payload_digest string, refers_to string"
)


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def record_id(archive: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{seq}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Reader:
    """Records of an uncompressed stream that comes in chunks; holds one record and one chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer = chunks, bytearray()

    def _fill(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.buffer += chunk
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            at = self.buffer.find(b"\r\n\r\n")
            while at < 0:
                seen = max(0, len(self.buffer) - 3)
                if not self._fill():
                    if self.buffer:
                        raise ValueError("a record is cut off")
                    return
                at = self.buffer.find(b"\r\n\r\n", seen)
            head = bytes(self.buffer[:at]).decode().split("\r\n")
            headers = {name: value.strip() for name, value in (line.split(":", 1) for line in head[1:])}
            start = at + 4
            end = start + int(headers.pop("Content-Length"))
            while len(self.buffer) < end + 4:
                if not self._fill():
                    raise ValueError("a record is cut off")
            block = bytes(self.buffer[start:end])
            del self.buffer[: end + 4]
            yield headers, block


def _inflated(stream) -> Iterator[bytes]:
    """A gzip stream of one member or several, in pieces of bounded size."""
    machine = zlib.decompressobj(GZIP)
    while data := stream.read(CHUNK):
        while data:
            yield machine.decompress(data, CHUNK)
            data = machine.unconsumed_tail
            if machine.eof:
                data, machine = machine.unused_data, zlib.decompressobj(GZIP)


def _member(data: bytes) -> bytes:
    machine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return machine.compress(data) + machine.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """One response record per page in archives of one gzip stream; returns their places and digests."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base)
        stream = machine = None
        archive, seq, size = "", 0, 0

        def close() -> None:
            stream.write(machine.flush())
            stream.close()

        for batch in batches:
            rows = []
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                if stream is None or size >= ARCHIVE_BYTES:
                    if stream is not None:
                        close()
                    archive, seq, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream, machine = system.open_output_stream(f"{base}/{archive}", compression=None), zlib.compressobj(
                        1, zlib.DEFLATED, GZIP)
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                headers = {
                    "WARC-Type": "response", "WARC-Record-ID": record_id(archive, seq),
                    "WARC-Date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
                }
                if url is not None:
                    headers["WARC-Target-URI"] = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")
                if page_id is not None:
                    headers["X-Page-Id"] = str(page_id)
                headers |= {
                    "WARC-Payload-Digest": f"sha256:{digest}",
                    "Content-Type": "application/http; msgtype=response",
                }
                data = record(headers, HTTP + payload)
                stream.write(machine.compress(data))
                rows.append((archive, seq, page_id, len(payload), digest))
                seq, size = seq + 1, size + len(data)
            yield _rows(rows, PLACES)
        if stream is not None:
            close()

    return map_arrow(pages.select("page_id", "url", "html"), run, PLACES)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [part.split() for part in ddl.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def revisits(places: DataFrame) -> DataFrame:
    """archive, seq and the record (archive, seq) that is revisited."""
    long = places.where(F.col("payload_bytes") >= REVISIT_BYTES)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "seq")
    first = long.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = long.join(first.where("n > 1").drop("n"), ["payload_digest", "payload_bytes"])
    return copies.where((F.col("archive") != F.col("first.archive")) | (F.col("seq") != F.col("first.seq"))).select(
        "archive", "seq", F.col("first.archive").alias("to_archive"), F.col("first.seq").alias("to_seq"))


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """One member per record and a sidecar for each archive; returns archive and the sidecar's name.

    ``archives``: archive, and ``seqs``, ``to_archives``, ``to_seqs`` of its records that become revisits.
    """
    ship(archives.sparkSession)

    def one(archive: str, into: dict[int, tuple[str, int]]) -> str:
        read_from, read_base = _open(source)
        system, base = _open(target)
        system.create_dir(base)
        name = f"{archive.split('.')[0]}-{uuid.uuid4().hex}"
        offset = 0
        with (
            read_from.open_input_stream(f"{read_base}/{archive}", compression=None) as stream,
            system.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out,
            system.open_output_stream(f"{base}/{name}.index", compression=None) as index,
        ):
            for seq, (headers, block) in enumerate(Reader(_inflated(stream))):
                if seq in into:
                    headers = headers | {
                        "WARC-Type": "revisit", "WARC-Refers-To": record_id(*into[seq]), "WARC-Profile": PROFILE}
                    block = block[: len(HTTP)]
                member = _member(record(headers, block))
                out.write(member)
                line = {"seq": seq, "type": headers["WARC-Type"], "id": headers["WARC-Record-ID"],
                        "offset": offset, "length": len(member)}
                index.write(json.dumps(line).encode() + b"\n")
                offset += len(member)
        return name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, seqs, to_archives, to_seqs in zip(*[c.to_pylist() for c in batch.columns]):
                into = dict(zip(seqs or (), zip(to_archives or (), to_seqs or ())))
                rows.append((archive, one(archive, into)))
            yield _rows(rows, "archive string, name string")

    return map_arrow(archives.select("archive", "seqs", "to_archives", "to_seqs"), run, "archive string, name string")


def read(names: DataFrame, folder: str) -> DataFrame:
    """All records of normalised archives, each fetched by its offset; the digest is that of the block's payload."""
    ship(names.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for archive, name in zip(*[c.to_pylist() for c in batch.columns]):
                rows = []
                with system.open_input_stream(f"{base}/{name}.index", compression=None) as stream:
                    index = [json.loads(line) for line in stream.read().splitlines()]
                with system.open_input_file(f"{base}/{name}.warc.gz") as file:
                    for line in index:
                        file.seek(line["offset"])
                        member = zlib.decompress(file.read(line["length"]), GZIP)
                        (headers, block), = Reader(iter([member]))
                        payload = block[len(HTTP):]
                        page_id = headers.get("X-Page-Id")
                        digest = hashlib.sha256(payload).hexdigest()
                        response = headers["WARC-Type"] == "response"
                        if response and headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                        rows.append((
                            archive, line["seq"], headers["WARC-Record-ID"], headers["WARC-Type"],
                            None if page_id is None else int(page_id), len(payload) if response else None,
                            headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers.get("WARC-Refers-To"),
                        ))
                yield _rows(rows, RECORDS)

    return map_arrow(names.select("archive", "name"), run, RECORDS)


def _each_its_task(df: DataFrame, spark: SparkSession, by: str) -> DataFrame:
    """An archive is minutes of work in one narrow row: spread rows that Spark would put together."""
    n = df.count()
    return df.repartition(max(1, n), by)


def roundtrip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, from their archives."""
    spark = pages.sparkSession
    raw, clean = scratch_path(spark, "warc-streams"), scratch_path(spark, "warc")
    places = settle(write(pages, raw), "warc-places")
    lists = revisits(places).groupBy("archive").agg(F.collect_list(F.struct("seq", "to_archive", "to_seq")).alias("r"))
    todo = settle(places.select("archive").distinct().join(lists, "archive", "left").select(
        "archive", F.col("r.seq").alias("seqs"), F.col("r.to_archive").alias("to_archives"),
        F.col("r.to_seq").alias("to_seqs")), "warc-todo")
    names = settle(normalise(_each_its_task(todo, spark, "archive"), raw, clean), "warc-names")
    records = settle(read(_each_its_task(names, spark, "archive"), clean), "warc-records")
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"))
    plain = records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    copies = records.where("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("_id")).select(
        "page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))
    return plain.unionByName(copies)

import gzip
import hashlib
import json
import re
import zlib

import pytest
from compare import connect, difference
from pyarrow import fs

from pagetrove.llm import queries, warc

PAGES = "page_id long, url string, html string, record_type string"
BIG = "<p>é same</p>" * 30


def expected(rows):
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html] = min(first.get(html, key), key)
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and first[html] != key
        out.append((key, len(payload), hashlib.sha256(payload).hexdigest(),
                    "revisit" if revisit else "response", first[html] if revisit else None))
    return out


@pytest.mark.parametrize("archive_bytes", [32 << 20, 500])
def test_roundtrip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    rows = [(i, f"http://h/é {i}\r\nX: y", BIG if i % 3 else f"<p>{i}</p>") for i in range(40, 0, -1)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", None), (103, "u", "x" * 99), (104, "u", "x" * 99),
             (105, "u", "WARC/1.1\r\n\r\n" * 50_000), (106, "u", "é" * 50), (107, "u", "é" * 50), (None, "u", BIG)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    got = sorted((tuple(r) for r in warc.roundtrip(df).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", BIG, "")] * 3 + [(2, "u", BIG, "")], PAGES)
    rows = warc.roundtrip(df).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in rows) == [
        (1, "response", 0), (1, "revisit", 1), (1, "revisit", 1), (2, "revisit", 1)]
    assert warc.roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def test_one_stream_in_one_member_per_record_out(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>", "") for i in range(5)], PAGES).coalesce(1)
    raw, clean = str(tmp_path / "raw"), str(tmp_path / "clean")
    places = warc.write(df, raw).collect()
    (archive,) = {p.archive for p in places}
    data = (tmp_path / "raw" / archive).read_bytes()
    machine = zlib.decompressobj(31)
    whole = machine.decompress(data)
    assert machine.eof and not machine.unused_data and whole.count(b"WARC/1.1") == 5
    todo = spark.createDataFrame([(archive, [], [], [])], "archive string, seqs array<int>, to_archives array<string>, to_seqs array<int>")
    (row,) = warc.normalise(todo, raw, clean).collect()
    members = (tmp_path / "clean" / f"{row.name}.warc.gz").read_bytes()
    lines = [json.loads(x) for x in (tmp_path / "clean" / f"{row.name}.index").read_text().splitlines()]
    assert [x["seq"] for x in lines] == list(range(5))
    parts = [gzip.decompress(members[x["offset"] : x["offset"] + x["length"]]) for x in lines]
    assert b"".join(parts) == whole
    for part in parts:
        (headers, _), = warc.Reader(iter([part]))
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["WARC-Date"])
    assert fs.FileSystem.from_uri(clean)[0].get_file_info(clean).type == fs.FileType.Directory


def test_archives_roll_by_records(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    df = spark.createDataFrame([(i, None, None, "") for i in range(100)], PAGES).coalesce(1)
    rows = warc.write(df, str(tmp_path)).groupBy("archive").count().collect()
    assert len(rows) > 5 and max(r["count"] for r in rows) < 20


def test_headers_without_blanks():
    (headers, block), = warc.Reader(iter([b"WARC/1.1\r\nA:b:c\r\nContent-Length:3\r\n\r\nabc\r\n\r\n"]))
    assert (headers, block) == ({"A": "b:c"}, b"abc")


def test_cut_off_record():
    whole = warc.record({"WARC-Type": "response"}, b"abc")
    with pytest.raises(ValueError):
        list(warc.Reader(iter([whole[:-3]])))


def test_query_equals_sql(spark, sf_dir):
    sql = queries.LLM_ORACLES["op1_warc"]
    assert difference(queries.op1_warc(spark, sf_dir), connect(sf_dir), sql) is None

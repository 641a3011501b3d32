import json
import random

import pytest
from pyspark.sql import functions as F

from pagetrove.functions.patterns import array_to_text
from pagetrove.operators.dedup import unique_url
from pagetrove.operators.numbering import assign_id
from pagetrove.operators.parse import overlong, parse_pages
from pagetrove.plans.ingest import IngestError, ingest
from pagetrove.schemas import STORED_COLUMNS
from pagetrove.sources.feed import (
    number_batches,
    read_feed,
    read_feed_array,
    write_feed,
    write_numbered_feed,
)
from pagetrove.sources.store import (
    admitted,
    bloom_words,
    create_store,
    read_side,
    read_store,
    scan_store,
    store_view,
    stored_urls,
)
from pagetrove.streaming.ingest import ingest_stream


def page(url, title="x", heading="Hi"):
    return {"url": url, "content": f"<title>{title}</title><h1>{heading}</h1>"}


LINES = [
    json.dumps(page("http://a.example/1")),
    json.dumps(page("http://a.example/1", "second")),
    '{"url":"x", broken',
    '{"content":"<p>"}',
    '{"url":"http://n.example/","content":null}',
    '{"url":"http://m.example/"}',
    json.dumps(page("http://long.example/", "t" * 256)),
    json.dumps(page("http://fits.example/", "t" * 255 + "   ")),
    json.dumps(page("http://late.example/" + "u" * 255)),
    json.dumps({"url": "http://plain.example/", "content": "<p>nothing</p>"}),
    json.dumps(page("http://b.example/", "Zwei", "null")),
]


def feed(tmp_path, name, lines):
    path = tmp_path / name
    path.mkdir(exist_ok=True)
    (path / "1-100.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def reasons(rejects):
    return sorted((r.reject_reason, r.url or "") for r in rejects.collect())


def test_good_rows_go_on_and_bad_ones_have_a_reason(spark, tmp_path):
    store = str(tmp_path / "store")
    result = ingest(read_feed(spark, feed(tmp_path, "feed", LINES)), store, 0)
    rows = [tuple(r) for r in scan_store(spark, store).orderBy("id").collect()]
    assert rows == [
        (1, None, "{hi}", None, None, "x", "http://a.example/1"),
        # 2 went to the copy, 3 and 5 to over-long values.
        (4, None, "{hi}", None, None, "t" * 255, "http://fits.example/"),
        (6, None, '{"null"}', None, None, "Zwei", "http://b.example/"),
    ]
    assert result.stored.count() == 3
    assert reasons(result.rejects) == [
        ("corrupt_json", ""),
        ("duplicate_url", "http://a.example/1"),
        ("invalid", "http://plain.example/"),
        ("missing_content", "http://m.example/"),
        ("missing_content", "http://n.example/"),
        ("missing_url", ""),
        ("too_long:title", "http://long.example/"),
        ("too_long:url", "http://late.example/" + "u" * 255),
    ]


def test_second_batch_skips_stored_urls_and_goes_on_counting(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest(read_feed(spark, feed(tmp_path, "one", LINES)), store, 0)
    more = [LINES[0], json.dumps(page("http://new.example/"))]
    for _ in range(2):  # a batch that is run again replaces itself
        result = ingest(read_feed(spark, feed(tmp_path, "two", more)), store, 1)
        got = read_store(spark, store).where("ingest_batch = 1").select("id", "url").collect()
        assert [tuple(r) for r in got] == [(8, "http://new.example/")]  # 7 went to the copy
        assert reasons(result.rejects) == [("duplicate_url", "http://a.example/1")]
    assert scan_store(spark, store).count() == 4


def test_large_batches_are_joined_without_broadcast(spark, tmp_path, monkeypatch):
    import pagetrove.sources.store as store_module

    monkeypatch.setattr(store_module, "BROADCAST_URLS", 0)
    store = str(tmp_path / "store")
    lines = read_feed(spark, feed(tmp_path, "feed", LINES))
    ingest(lines, store, 0)
    assert ingest(lines, store, 1).stored.count() == 0


def test_fail_on_bad_records(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(IngestError, match="corrupt_json"):
        ingest(read_feed(spark, feed(tmp_path, "feed", LINES)), store, 0, on_error="fail")
    assert scan_store(spark, store).count() == 0
    clean = [LINES[0], LINES[9]]  # a page without headings is no error
    assert ingest(read_feed(spark, feed(tmp_path, "ok", clean)), store, 0, on_error="fail").stored.count() == 1


def test_arrival_order_decides(spark, tmp_path):
    path = tmp_path / "feed"
    path.mkdir()
    for name, title in (("2.json", "late"), ("1.json", "early")):
        (path / name).write_text(json.dumps(page("http://same.example/", title)) + "\n")
    result = ingest(read_feed(spark, str(path)), str(tmp_path / "store"), 0)
    assert [r.title for r in result.stored.collect()] == ["early"]
    store_view(spark, str(tmp_path / "store"), "documents_view")
    found = spark.sql("SELECT url FROM documents_view WHERE title ILIKE :p", args={"p": "%EARL%"})
    assert [r.url for r in found.collect()] == ["http://same.example/"]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("html", "content")
    path = str(tmp_path / "feed")
    write_feed(pages, path)
    (tmp_path / "feed" / "zz.json").write_text("\n".join(LINES[:5]) + "\n")
    batch_store, stream_store, rejects = (str(tmp_path / n) for n in ("batch", "stream", "rejects"))
    batch = ingest(read_feed(spark, path), batch_store, 0)
    ingest_stream(
        spark, path, stream_store, str(tmp_path / "progress"), rejects, objects_per_trigger=2
    ).awaitTermination()
    columns = [c for c in STORED_COLUMNS if c != "id"]
    want = sorted(map(tuple, scan_store(spark, batch_store).select(columns).collect()), key=repr)
    got = sorted(map(tuple, scan_store(spark, stream_store).select(columns).collect()), key=repr)
    assert want == got and len(got) > 40
    ids = [r.id for r in scan_store(spark, stream_store).collect()]
    assert len(set(ids)) == len(ids)
    assert reasons(spark.read.parquet(rejects)) == reasons(batch.rejects)
    assert len(got) + batch.rejects.count() == pages.count() + 5


def test_runs_on_one_store_keep_each_others_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest(read_feed(spark, feed(tmp_path, "zero", [json.dumps(page("http://zero.example/"))])), store, 0)
    for name in ("one", "two"):
        path = feed(tmp_path, name, [json.dumps(page(f"http://{name}.example/")), LINES[0]])
        ingest_stream(spark, path, store, str(tmp_path / f"progress-{name}")).awaitTermination()
    rows = scan_store(spark, store).collect()
    assert sorted(r.url for r in rows) == [
        "http://a.example/1", "http://one.example/", "http://two.example/", "http://zero.example/"]
    assert len({r.id for r in rows}) == 4


def test_numbers_go_on_after_a_batch_that_kept_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest(read_feed(spark, feed(tmp_path, "one", LINES[:2])), store, 0)
    ingest(read_feed(spark, feed(tmp_path, "two", LINES[:2])), store, 1)
    ingest(read_feed(spark, feed(tmp_path, "three", LINES[9:])), store, 2)
    assert sorted(r.id for r in scan_store(spark, store).collect()) == [1, 5]


def test_a_batch_reads_only_what_filters_admit(spark, tmp_path):
    store = str(tmp_path / "store")
    pages = lambda n: [json.dumps(page(f"http://a.example/{i}")) for i in range(n * 300, n * 300 + 300)]
    for n in range(3):
        ingest(read_feed(spark, feed(tmp_path, f"feed{n}", pages(n))), store, n)
    every = F.lit(True)
    held = [f"http://a.example/{i}" for i in range(900)]
    others = [f"http://b.example/{i}" for i in range(5_000)]
    blooms = read_side(spark, store, "_blooms")
    found = admitted(spark.createDataFrame([(u,) for u in held + others], "url string"), blooms)
    passed = [r.url for r in found.select("url").distinct().collect()]
    assert set(held) <= set(passed) and len(passed) < 900 + 100
    owners = {(r.url, r.ingest_batch) for r in found.collect()}
    assert {(u, i // 300) for i, u in enumerate(held)} <= owners
    known = stored_urls(spark, store, spark.createDataFrame([(held[7],), (others[3],)], "url string"), every)
    assert [r.url for r in known.collect()] == [held[7]]
    files = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and "url_part" in files
    none = spark.createDataFrame([("http://c.example/",)], "url string")
    assert stored_urls(spark, store, none, every).count() == 0


def test_bloom_words_hold_every_url(spark):
    urls = spark.range(40_000).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 3).cast("int").alias("url_part"))
    words = bloom_words(urls, 40_000)
    assert words.where("word >= words").isEmpty()
    assert {r.words for r in words.select("words").distinct().collect()} == {1024}
    assert admitted(urls.select("url").limit(500), words.withColumns({"ingest_run": F.lit("r"), "ingest_batch": F.lit(0)}).withColumn(
        "url_part", F.explode(F.array(*map(F.lit, range(32)))))).select("url").distinct().count() == 500


def test_feed_objects_hold_25_lines(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("html", "content")
    path = tmp_path / "plain"
    write_feed(pages.coalesce(1), str(path))
    assert sorted(len(f.read_text().splitlines()) for f in path.glob("*.json")) == [25, 25]
    numbered = tmp_path / "numbered"
    write_numbered_feed(pages, str(numbered), ["page_id"])
    sizes = {d.name: [len(f.read_text().splitlines()) for f in d.glob("*.json")] for d in numbered.glob("batch_id=*")}
    assert sizes == {"batch_id=1": [25], "batch_id=2": [25]}
    batches = number_batches(pages, ["page_id"]).collect()
    assert all(r.idx == r.page_id and r.batch_id == r.idx // 25 + 1 for r in batches)


def test_array_feed(spark, tmp_path):
    (tmp_path / "crawled.json").write_text(json.dumps([page("http://a/"), page("http://b/")]))
    rows = read_feed_array(spark, str(tmp_path / "crawled.json")).select("url", "_corrupt_record").collect()
    assert sorted(map(tuple, rows)) == [("http://a/", None), ("http://b/", None)]


def test_one_array_is_read_by_many_tasks(spark, tmp_path, sf_dir):
    chance = random.Random(11)
    bits = ["{", "}", '"', "\\", '\\"', "[", "]", ",", "é", "日本", "\n", " ", '{"url":', "word", "}}", "</h1>"]
    pages = [{"url": f"u{i}", "content": "".join(chance.choices(bits, k=chance.randrange(80)))} for i in range(400)]
    pages[7] = {"url": "u7", "content": None}
    pages[8] = {"content": "}", "more": {"a": [{"b": "}"}, {}]}}
    pages[9] = {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1500")
    try:
        for k, kw in enumerate([{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}]):
            path = tmp_path / f"arrays{k}"
            path.mkdir()
            (path / "a.json").write_text(json.dumps(pages, **kw), encoding="utf-8")
            (path / "b.json").write_text("[]")
            (path / "c.json").write_text(" \n" + json.dumps(pages[20:22], **kw) + "\n", encoding="utf-8")
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10
            rows = read_feed_array(spark, str(path)).orderBy("_file", "_block", "_seq").collect()
            got = [(r._file[-6:], r.url, r.content, r._corrupt_record) for r in rows]
            assert got == [(f, p.get("url"), p.get("content"), None)
                           for f, ps in (("a.json", pages), ("c.json", pages[20:22])) for p in ps]
        cut = tmp_path / "cut.json"
        cut.write_text(json.dumps(pages)[:-30])
        rows = read_feed_array(spark, str(cut)).orderBy("_block", "_seq").collect()
        assert [r.url for r in rows][:399] == [p.get("url") for p in pages[:399]]
        assert len(rows) == 400 and rows[-1]._corrupt_record
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_store_is_created_once(spark, tmp_path):
    store = str(tmp_path / "store")
    create_store(spark, store)
    create_store(spark, store)
    assert scan_store(spark, store).columns == STORED_COLUMNS and scan_store(spark, store).count() == 0


def test_ids_are_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = sorted((r.k, r.id) for r in assign_id(rows, ["k"], first=5).collect())
    assert got == [(k, k + 5) for k in range(1000)]


def test_hot_url_is_reduced_before_the_shuffle(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("url"),
        (-F.col("id")).alias("_seq"),
    )
    got = unique_url(rows, ["_seq"])
    assert got.count() == 2001 and got.where("url = 'hot'").first()._seq == -2997
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(_at" in plan


def test_array_text(spark):
    cases = [["one"], ["two words", "x"], ["null", "nULL", "nulls"], []]
    df = spark.createDataFrame([(c,) for c in cases], "a array<string>")
    got = [r[0] for r in df.select(array_to_text(F.col("a"))).collect()]
    assert got == ["{one}", '{"two words",x}', '{"null","nULL",nulls}', "{}"]


def test_length_limit_forgives_trailing_spaces_only(spark):
    df = spark.createDataFrame([("a" * 255,), ("a" * 256,), ("a" * 255 + "  ",), ("é" * 255,), (None,)], "title string")
    assert [r[0] for r in df.select(overlong("title")).collect()] == [False, True, False, False, False]


def test_filter_on_fields_stays_above_the_extraction(spark):
    pages = spark.createDataFrame([("u", "<title>t</title><h1>a b c</h1>")], "url string, content string")
    plan = parse_pages(pages).where("title is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</title") == plan[plan.index("Generate"):].count("</title")


def test_refused_texts_are_not_written_and_parts_have_a_file(spark, tmp_path, monkeypatch):
    import pagetrove.plans.ingest as plan

    written = {}

    def settled(df, name, settle=plan.settle):
        written[name] = settle(df, name)
        return written[name]

    monkeypatch.setattr(plan, "settle", settled)
    lines = [json.dumps(page(f"http://a.example/{i}", "t" * (300 if i % 2 else 20))) for i in range(400)]
    store = str(tmp_path / "store")
    stored, rejects = ingest(read_feed(spark, feed(tmp_path, "feed", lines)).repartition(4), store, 0, file_rows=10)
    refused = written["judged"].where("reject_reason is not null")
    assert refused.where("title is null and content_text is null and url is not null").count() == refused.count() == 200
    assert {(r.title, r.content) for r in stored.collect()} == {("t" * 20, "{hi}")} and stored.count() == 200
    assert {(r.reject_reason, r.url) for r in rejects.collect()} == {
        ("too_long:title", f"http://a.example/{i}") for i in range(1, 400, 2)}
    files = [str(f.parent) for f in (tmp_path / "store" / "_urls").rglob("*.parquet")]
    assert len(files) == len(set(files)) > 16
    assert read_side(spark, store, "_urls").count() == 200

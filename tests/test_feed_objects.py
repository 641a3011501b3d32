"""The sink of numbered feed objects."""

import json
import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagetrove.sources.objects import _sink, write_feed_objects

SCHEMA = "a int, b string, url string, content string, part string"


def objects_of(path):
    files = {int(f.stem): f for f in path.glob("part-*/*.json")}
    assert len(files) == len(list(path.rglob("*.json")))
    return {n: [json.loads(line) for line in files[n].read_text().split("\n")[:-1]] for n in sorted(files)}


@pytest.mark.parametrize("rows", [1, 25, 26, 403])
def test_objects_are_numbered_in_order(spark, tmp_path, rows):
    """Two order columns, nulls among them; null and long contents, line ends, quotes; a column of an internal name."""
    texts = [None, "", 'a"b\\\n é', "<p>" * 50000]
    made = [(None if i < 7 else i // 5, f"{i % 5}-{i:04}", f"http://a/{i}", texts[i % 4], "x") for i in range(rows)]
    pages = spark.createDataFrame(made, SCHEMA)
    write_feed_objects(pages.orderBy(F.xxhash64("url")), str(tmp_path / "feed"), ["a", "b"])
    expected = [{"url": r[2], "content": r[3]} for r in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert objects_of(tmp_path / "feed") == {n // 25 + 1: expected[n:n + 25] for n in range(0, rows, 25)}
    assert [p.name for p in tmp_path.iterdir()] == ["feed"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    pages = spark.range(300).select("id", F.lit("http://a/").alias("url"), F.lit("x").alias("content"))
    fails = pages.withColumn("content", F.when(F.col("id") == 299, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write_feed_objects(fails, str(tmp_path / "feed"), ["id"])
    with pytest.raises(Exception, match="not unique"):
        write_feed_objects(pages.unionByName(pages), str(tmp_path / "feed"), ["id"])
    assert not list(tmp_path.iterdir())


def test_existing_path_and_empty_table(spark, tmp_path):
    pages = spark.range(0).select("id", F.lit("http://a/").alias("url"), F.lit("x").alias("content"))
    write_feed_objects(pages, str(tmp_path / "feed"), ["id"])
    assert (tmp_path / "feed").is_dir() and not objects_of(tmp_path / "feed")
    with pytest.raises(FileExistsError):
        write_feed_objects(pages, str(tmp_path / "feed"), ["id"])


def test_only_attempts_that_report_are_published(tmp_path):
    """A task that was repeated, and one that was lost half-way, leave no extra object."""
    options = {"path": str(tmp_path / "feed"), "staging": str(tmp_path / "staging"), "rows": "30", "share": "50", "per_object": "25"}
    writer = _sink()(options).writer(None, False)
    lines = pa.RecordBatch.from_pydict({"part": pa.array([0] * 30, pa.int32()), "line": [f'{{"url": "{i}"}}' for i in range(30)]})
    writer.write(iter([lines]))
    with pytest.raises(ValueError, match="not unique"):
        writer.write(iter([lines.slice(0, 27)]))
    reported = writer.write(iter([lines]))
    with pytest.raises(ValueError, match="missing"):
        writer.commit([])
    assert not (tmp_path / "feed").exists()
    writer.commit([reported, None])
    assert {n: len(rows) for n, rows in objects_of(tmp_path / "feed").items()} == {1: 25, 2: 5}
    assert not (tmp_path / "staging").exists()


def test_the_sink_needs_no_package_on_executors(tmp_path):
    """What Spark sends to executors is loaded and run by a Python that cannot import this package."""
    options = {"path": str(tmp_path / "feed"), "staging": str(tmp_path / "staging"), "rows": "3", "share": "25", "per_object": "25"}
    (tmp_path / "writer").write_bytes(cloudpickle.dumps(_sink()(options).writer(None, False)))
    code = """
import importlib.util, pickle, sys
import pyarrow as pa
assert importlib.util.find_spec("pagetrove") is None
writer = pickle.load(open("writer", "rb"))
lines = pa.RecordBatch.from_pydict({"part": pa.array([0] * 3, pa.int32()), "line": ["{}"] * 3})
writer.commit([writer.write(iter([lines]))])
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, check=True, timeout=60)
    assert objects_of(tmp_path / "feed") == {1: [{}, {}, {}]}

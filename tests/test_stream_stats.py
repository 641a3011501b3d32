import time
from types import SimpleNamespace

from pyspark.sql import Row

from pagetrove.operators.stats import crawl_stats
from pagetrove.streaming.stats import METRIC, CrawlCounters, observed

SCHEMA = "url string, status int"


def test_totals_over_micro_batches_and_a_restart(spark, tmp_path):
    path, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    rows = [(f"http://h{i % 7}.example/{i}", [200, 200, 404, None][i % 4]) for i in range(100)]
    heard = CrawlCounters()
    spark.streams.addListener(heard)
    asked = CrawlCounters()
    try:
        for part in (rows[:60], rows[60:]):
            spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(path)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
            query = observed(stream).writeStream.format("noop").option("checkpointLocation", progress).trigger(
                availableNow=True).start()
            query.awaitTermination()
            asked.catch_up(query)
        want = {"responses": 100, "fetched": 50, "refused": 50}
        assert asked.totals() == want and len(asked.batches) == 6
        for _ in range(100):
            if heard.totals() == want:
                break
            time.sleep(0.1)
        assert heard.batches == asked.batches
    finally:
        spark.streams.removeListener(heard)
    by_host = crawl_stats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {k: sum(r[k] for r in by_host) for k in want} == want


def test_a_repeated_micro_batch_counts_once():
    counters = CrawlCounters()
    for batch, fetched in ((0, 5), (1, 3), (1, 4), (0, 5)):
        counted = {METRIC: Row(responses=fetched + 1, fetched=fetched, refused=1)}
        counters.note(SimpleNamespace(id="q", batchId=batch, observedMetrics=counted))
    counters.note(SimpleNamespace(id="q", batchId=2, observedMetrics={}))
    assert counters.totals() == {"responses": 11, "fetched": 9, "refused": 2}

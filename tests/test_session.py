from pathlib import Path

from pagetrove.session import clear_scratch, scratch_path, settle, settle_counted, shared_dir


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_settle_and_clear(spark):
    settled, rows = settle_counted(spark.range(10).repartition(3), "numbers")
    assert rows == 10 and settled.count() == 10
    assert settle_counted(spark.range(0), "none")[1] == 0
    assert "Range" not in settle(spark.range(5), "cut")._jdf.queryExecution().optimizedPlan().toString()
    folder = Path(shared_dir(spark)) / "pagetrove" / spark.sparkContext.applicationId
    assert any(folder.iterdir())
    clear_scratch(spark)
    assert not folder.exists()

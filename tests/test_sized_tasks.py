"""The number of tasks follows the input, not the session."""

import datetime as dt

from tidebar.plans import catalog
from tidebar.sources import bars as src

SESSION = 4  # shuffle partitions of the tests


def table(spark, path):
    day = dt.datetime(1998, 8, 7)
    rows = [(n, n % 50 + 1, 1.0, 0.09, 0.04, day + dt.timedelta(days=n // 50)) for n in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_bars_are_dealt_over_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "TASK_ROWS", 100)
    sf = table(spark, tmp_path)
    assert src.bars_walk(spark, sf).rdd.getNumPartitions() == 10 > SESSION
    assert catalog.QUERIES["w1_moving_averages"](spark, sf).rdd.getNumPartitions() == 10
    assert catalog.QUERIES["sg6_signals"](spark, sf).rdd.getNumPartitions() == 10
    assert catalog.QUERIES["tp2_first_exits"](spark, sf).rdd.getNumPartitions() == 10


def test_merges_are_dealt_over_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "TASK_ROWS", 100)
    sf = table(spark, tmp_path)
    for name in ("s10_upsert_bars", "s16_backfill_date"):
        got = catalog.QUERIES[name](spark, sf)
        assert got.rdd.getNumPartitions() == 10
        assert got.count() == 1000 + (50 if name == "s10_upsert_bars" else 0)
    assert catalog.QUERIES["s11_insert_ignore"](spark, sf).rdd.getNumPartitions() == 20


def test_frames_that_regime_and_score_read_are_computed_once(spark, tmp_path):
    sf = table(spark, tmp_path)
    plan = catalog.QUERIES["tp1_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    long_means = [line for line in plan.splitlines() if "Window [" in line for _ in range(line.count("RowFrame, -119, currentrow$()"))]
    assert len(long_means) == 1

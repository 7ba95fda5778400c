"""Streaming forms equal their batch forms on the same rows."""

import datetime
import os

from tidebar.sources import bars as src
from tidebar.streaming import bars as streaming
from tidebar.streaming import monitor

BAR = "symbol string, date int, close double"
TRADE = "strategy_id string, closed_at timestamp, i long, pnl double, pnl_pct double"
KNOWN = "strategy_id string, status string, validation_sharpe double, live_max_dd double, degraded_since date"


def files(spark, path, schema, *parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def stored(folder):
    """Data folders of a table that hold files."""
    return sorted(os.path.relpath(d, folder) for d, _, names in os.walk(folder) if any(n.endswith(".parquet") for n in names) and "/data/" in d)


def test_upsert_stream_equals_batch(spark, tmp_path):
    first, second = [("a", 1, 1.0), ("b", 1, 2.0)], [("a", 1, 9.0), ("c", 2, 3.0)]
    stream = files(spark, str(tmp_path / "in"), BAR, first, second)
    q = streaming.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, streaming.BucketTable(spark, str(tmp_path / "out")).read(BAR).collect()))
    want = src.upsert(spark.createDataFrame(first, BAR), spark.createDataFrame(second, BAR), ["symbol", "date"])
    assert got == sorted(map(tuple, want.collect()))


def test_a_batch_rewrites_its_own_buckets_and_a_replay_nothing(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, BAR)
    t = streaming.BucketTable(spark, str(tmp_path / "t"), buckets=8, keep_versions=1)
    symbols = [f"s{k}" for k in range(40)]
    t.merge(frame([(s, 1, 1.0) for s in symbols]), 0)
    before = t.manifest()
    assert len(before) == 8
    t.merge(frame([("s3", 1, 2.0), ("s3", 2, 3.0)]), 1)
    after = t.manifest()
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and after[changed[0]] == f"data/v=1/bucket={changed[0]}"
    assert stored(tmp_path / "t") == sorted(after.values())  # the bucket's old folder is gone
    t.merge(frame([("s3", 1, 77.0), ("s4", 1, 77.0)]), 1)
    assert t.manifest() == after
    rows = {(r["symbol"], r["date"]): r["close"] for r in t.read(BAR).collect()}
    assert len(rows) == 41 and rows["s3", 1] == 2.0 and rows["s3", 2] == 3.0 and rows["s4", 1] == 1.0
    t.merge(frame([]), 2)
    assert t.manifest() == after


def test_an_attempt_without_manifest_does_not_count(spark, tmp_path):
    t = streaming.BucketTable(spark, str(tmp_path / "t"), buckets=2)
    assert t.versions() == [] and t.read(BAR).count() == 0
    t.merge(spark.createDataFrame([("a", 1, 1.0)], BAR), 0)
    spark.createDataFrame([("a", 1, 5.0, 0)], BAR + ", bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "t" / "data" / "v=1"))
    assert [r["close"] for r in t.read(BAR).collect()] == [1.0]
    t.merge(spark.createDataFrame([("b", 1, 2.0)], BAR), 1)
    assert sorted(map(tuple, t.read(BAR).collect())) == [("a", 1, 1.0), ("b", 1, 2.0)]


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_monitor_stream_keeps_its_state(spark, tmp_path):
    trades = [("s", day(i), i, 1.0 if i % 4 == 0 else -1.0, 2.0 if i % 4 == 0 else -0.5) for i in range(90)]
    log = spark.createDataFrame(trades + [("unknown", day(3), 3, 1.0, 1.0)], TRADE)
    known = spark.createDataFrame([("s", "active", None, None, None)], KNOWN)
    rules = monitor.Rules(short=60, least_trades=1000)
    one = monitor.replay(log, known, str(tmp_path / "one"), [], rules).orderBy("n").collect()
    many = monitor.replay(log, known, str(tmp_path / "many"), ["2024-01-20", "2024-02-20"], rules).orderBy("n").collect()
    assert one == many and len(one) == 90
    assert (one[-1]["n"], one[-1]["consec_losses"]) == (90, 1) and abs(one[-1]["win_rate"] - 15 / 60) < 1e-9


def test_status_rules_and_the_timer(spark, tmp_path):
    lost, won = (-1.0, -3.0), (1.0, 3.0)
    steps = lambda name, start, results: [(name, day(start + k), k, *r) for k, r in enumerate(results)]
    mixed = [won, (1.0, 2.0), (1.0, 4.0), (1.0, 1.0)]
    log = (
        steps("falls", 0, [won, lost, lost, lost, lost, lost]) + steps("recovers", 0, mixed * 3) + steps("quiet", 0, [lost, (-1.0, -2.0)])
        + steps("late", 0, [lost, (-1.0, -2.0)]) + [("late", day(90), 9, 1.0, 50.0)] + [("clock", day(100), 1, 1.0, 1.0)])
    known = [("falls", "active", 0.5, None, None), ("recovers", "degraded", None, None, day(0).date()), ("quiet", "degraded", None, None, day(5).date()), ("late", "degraded", None, None, day(20).date()),
             ("silent", "degraded", None, None, day(30).date()), ("young", "degraded", None, None, day(60).date()), ("old", "retired", None, None, None), ("clock", "active", None, None, None)]
    got = monitor.replay(spark.createDataFrame(log, TRADE), spark.createDataFrame(known, KNOWN), str(tmp_path / "m"), ["2024-01-09"]).collect()
    acts = lambda name: [(r["checked_at"], r["action"], r["rules"], r["status"]) for r in sorted(got, key=lambda r: (r["checked_at"], r["n"])) if r["strategy_id"] == name and r["action"] != "ok"]
    assert acts("falls")[0] == (day(4), "degrade", "R1", "degraded")
    assert acts("recovers")[0][1:] == ("recover", "", "active")
    assert acts("quiet") == [(day(65), "retire", "E1", "retired")]
    assert acts("late") == [(day(80), "retire", "E1", "retired")]  # before the trade that came after the deadline
    assert acts("silent") == [(day(90), "retire", "E1", "retired")]  # without any trade
    assert acts("young") == [] and acts("old") == []
    assert not [r for r in got if r["strategy_id"] == "late" and r["checked_at"] > day(80)]

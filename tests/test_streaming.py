"""Streams of Parquet files through the incremental operators."""

import datetime as dt

from pyspark.sql import functions as F

from tidebar.sources import store
from tidebar.streaming import ingest

BARS = "scode string, ts timestamp, open double, close double, high double, low double, volume double, amount double"


def put(spark, path, rows):
    spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(path)


def bar(day, close, scode="1"):
    return (scode, dt.datetime(2026, 1, 1, 15) + dt.timedelta(days=day), close, close, close + 1, close - 1, 10.0, 1.0)


def test_upserts_resume_and_repeat(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put(spark, source, [bar(0, 1.0), bar(1, 2.0)])
    for more, total in (([], 2), ([bar(1, 5.0), bar(2, 3.0)], 3), ([], 3)):
        if more:
            put(spark, source, more)
        ingest.upserting(spark.readStream.schema(BARS).parquet(source), target, ["scode", "ts"], state).awaitTermination()
        found = store.read_table(spark, target).collect()
        assert len(found) == total
    assert {r.close for r in found} == {1.0, 5.0, 3.0}


def test_weeks_close_on_friday(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, [bar(i, float(i + 1)) for i in range(12)])
    stream = ingest.weekly_bars(spark.readStream.schema(BARS).parquet(source))
    query = stream.writeStream.format("memory").queryName("weeks").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    found = {str(r.trade_date): (r.open, r.close) for r in spark.table("weeks").collect()}
    assert found == {"2026-01-02": (1.0, 2.0), "2026-01-09": (3.0, 9.0)}


def test_cooldown_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", d) for d in (1, 10, 22)], "scode string, day_index long").write.parquet(source)
    query = ingest.cooled_signals(spark.readStream.schema("scode string, day_index long").parquet(source), 20).writeStream.format("memory").queryName("cooled").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.day_index for r in spark.table("cooled").collect()) == [1, 22]


def test_fresh_bars_once_over_batches(spark, tmp_path):
    source, state, target = (str(tmp_path / x) for x in ("in", "state", "out"))
    for rows in ([bar(0, 1.0), bar(20, 2.0)], [bar(20, 2.5), bar(21, 3.0), bar(0, 9.0), bar(21, 3.0, "2")], [bar(5, 4.0), bar(12, 5.0)]):
        put(spark, source, rows)
        stream = ingest.fresh_bars(spark.readStream.schema(BARS).parquet(source), "10 days")
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r.scode, r.ts.day, r.close) for r in spark.read.parquet(target).collect())
    # each bar once, the first that came; the fifth day is more than ten days behind the twenty-first when it arrives, the twelfth is not
    assert found == [("1", 1, 1.0), ("1", 13, 5.0), ("1", 21, 2.0), ("1", 22, 3.0), ("2", 22, 3.0)]


def test_event_counts_equal_a_batch(spark, tmp_path):
    """Closed windows of the stream over the given events, file by file in order of time, against a plain aggregation."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source, state, target = (str(tmp_path / x) for x in ("in", "state", "out"))
    bounds = events.select(F.percentile_approx("ts", [0.33, 0.66])).first()[0]
    parts = (F.col("ts") < bounds[0], (F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]), F.col("ts") >= bounds[1])
    for part in parts:
        events.where(part).coalesce(1).write.mode("append").parquet(source)
        counts = ingest.event_counts(spark.readStream.schema(events.schema).parquet(source), "1 day", "2 hours")
        counts.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    last = events.agg(F.max("ts")).first()[0]
    plain = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    closed = plain.where(F.col("window.end") <= F.lit(last) - F.expr("INTERVAL 2 HOURS")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    found = spark.read.parquet(target).withColumn("total", F.round("total", 4))
    assert closed.count() > 0 and sorted(map(tuple, found.collect())) == sorted(map(tuple, closed.collect()))

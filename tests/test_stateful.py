"""Streams with keyed state equal their batch operators over any split into batches, and after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import portfolio
from tidebar.streaming import stateful

BARS = "scode string, ts timestamp, open double, close double, high double, low double, volume double, amount double"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.with_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drained(spark, stream, out, state):
    """Run the stream over what has arrived, and end."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def bar_rows(rng, symbols=4, days=130):
    out = []
    for s in range(symbols):
        for d in range(days):
            if rng.random() < 0.8:
                close = round(rng.uniform(5, 20), 2)
                out.append((f"{s:06}", dt.datetime(2025, 11, 20) + dt.timedelta(days=d), close - 0.5, close, close + 1, close - 1, float(rng.randint(1, 9)), None if rng.random() < 0.1 else float(rng.randint(1, 99))))
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("batches", [1, 4])
def test_months_close_by_timers(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = bar_rows(rng)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), batches - 1)), len(rows)]
    late = 0
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        rng.shuffle(part)
        put(spark, source, part, BARS)
        late += stateful.late_rows(drained(spark, stateful.monthly_bars(spark.readStream.schema(BARS).parquet(source), "1 day"), out, state))  # each run is a restart
    put(spark, source, [("000000", dt.datetime(2026, 1, 3), 1.0, 1.0, 99.0, 1.0, 1.0, 1.0)], BARS)  # behind the watermark
    late += stateful.late_rows(drained(spark, stateful.monthly_bars(spark.readStream.schema(BARS).parquet(source), "1 day"), out, state))
    assert late == 1
    daily = spark.createDataFrame(rows, BARS).withColumn("trade_date", F.to_date("ts"))
    end = max(r[1] for r in rows).date()
    columns = ["scode", "trade_date", "open", "close", "high", "low", "volume", "amount"]
    want = sorted(map(tuple, B.resample(daily, "M", str(end)).select(columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == want and len(want) > 8


@pytest.mark.parametrize("batches, stored", [(1, False), (5, False), (3, True)])
def test_daily_picks(spark, tmp_path, batches, stored):
    rng = random.Random(10 * batches + stored)
    schema = "strategy_name string, sname string, scode string, d string, score double"
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(40) if (i + 3) % 7 < 5]
    rows = [("one" if s % 2 else "two", "*ST x" if s == 5 else f"n{s}", f"{s:06}", str(d), rng.choice([None, 0.5, round(rng.random(), 2)])) for d in days for s in range(12) if rng.random() < 0.6]
    calendar = spark.createDataFrame([(str(d), i) for i, d in enumerate(days)], "d string, day_index int").selectExpr("cast(d as date) trade_date", "day_index")
    whole = spark.createDataFrame(rows, schema).withColumn("trade_date", F.to_date("d"))
    first = str(days[6]) if stored else str(days[0])
    batch = portfolio.selected(whole, calendar, cooldown_days=4, limit=2)
    want = sorted((r.strategy_name, str(r.trade_date), r.scode) for r in batch.collect())
    before = batch.where(f"trade_date < DATE '{first}'").select("strategy_name", "scode", "trade_date") if stored else None
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    todo = [r for r in rows if r[3] >= first]
    cuts = [0, *sorted(rng.sample(range(1, len(todo)), batches - 1)), len(todo)]  # a day may be cut in two
    for a, b in zip(cuts, cuts[1:]):
        part = todo[a:b]
        rng.shuffle(part)
        put(spark, source, part, schema)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("trade_date", F.to_date("d"))
        drained(spark, stateful.picked_signals(stream, calendar, limit=2, cooldown=4, lateness="1 day", before=before), out, state)
    found = sorted((r.strategy_name, str(r.trade_date), r.scode) for r in spark.read.parquet(out).collect())
    last = max(r[3] for r in todo)
    closed = str(dt.date.fromisoformat(last) - dt.timedelta(days=2))  # what the watermark, a day behind, has passed
    assert [r for r in found if r[1] <= closed] == [r for r in want if first <= r[1] <= closed] and len(found) > 20
    assert set(found) <= set(want)


def test_corrections_rebuild_their_symbols(spark, tmp_path):
    plans = "scode string, plan string, content_hash string"
    source, tables, state = (str(tmp_path / x) for x in ("in", "tables", "state"))
    bars = spark.createDataFrame([(f"{s:06}", dt.datetime(2026, 1, 1) + dt.timedelta(days=d), 1.0, 2.0 + s, 3.0 + s, 1.0, 1.0, 1.0) for s in range(6) for d in range(40)], BARS).withColumn("trade_date", F.to_date("ts")).drop("ts")
    stateful.write_bars(bars, tables, "2026-02-10")
    asked = []

    def corrected(symbols):
        asked.append(sorted(r.scode for r in symbols.collect()))
        return bars.join(symbols, "scode", "left_semi").withColumn("close", F.col("close") * 10)

    same = [(f"{s:06}", p, f"h{s}{p}") for s in range(6) for p in ("2024", "2025")]
    for rows in (same, same, [("000001", "2025", "new"), ("000004", "2026", "a new plan"), ("000002", "2024", "h22024")], [("000001", "2025", "new")]):
        put(spark, source, rows, plans)
        stateful.rebuilding(spark.readStream.schema(plans).parquet(source), corrected, tables, "2026-02-10", state).awaitTermination()
    assert asked == [["000001"]]
    wanted = bars.withColumn("close", F.when(F.col("scode") == "000001", F.col("close") * 10).otherwise(F.col("close")))
    for name, want in (("daily", wanted), ("weekly", B.resample(wanted, "W", "2026-02-10")), ("monthly", B.resample(wanted, "M", "2026-02-10"))):
        found = spark.read.parquet(f"{tables}/{name}").select(*want.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))

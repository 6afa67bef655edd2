"""Bars by symbol behind a cursor each: full, incremental, and as a stream that stops and goes on."""

import json

import pyarrow as pa
import pytest

from tidebar.sources import cursors, store
from tidebar.streaming import ingest

SCHEMA = "scode string, trade_date string, close double"
HISTORY = [(f"s{i}", f"2026-01-{d:02}", float(10 * i + d)) for i in range(7) for d in range(1, 4 + i % 3)]


def put(spark, path, rows, schema=SCHEMA, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture
def provider(spark, tmp_path):
    """A provider's folder and listing, a source over them, and a log of what has been fetched."""
    bars, listing, log = (str(tmp_path / x) for x in ("bars", "listing", "log.jsonl"))
    put(spark, bars, HISTORY)

    def tell(rows):
        put(spark, listing, rows, "scode string, trade_date string", "overwrite")

    read = cursors.parquet_fetch(bars, ["scode", "trade_date", "close"])

    def fetch(wanted):
        with open(log, "a") as f:
            f.write(json.dumps([list(w) for w in wanted]) + "\n")
        yield from read(wanted)

    name = f"bars_{tmp_path.name}"
    spark.dataSource.register(cursors.symbol_source(name, spark.createDataFrame([], SCHEMA).schema, cursors.listed(listing), fetch))
    tell(sorted({s: max(d for t, d, _ in HISTORY if t == s) for s, _, _ in HISTORY}.items()))

    def asked():
        try:
            with open(log) as f:
                found = [w for line in f for w in json.loads(line)]
        except FileNotFoundError:
            return []
        open(log, "w").close()
        return found

    return name, bars, tell, asked


def test_full_reads_everything_and_incremental_what_is_behind(spark, provider):
    name, _, _, asked = provider
    full = spark.read.format(name).option("symbolsPerTask", 2).load()
    assert sorted(tuple(r) for r in full.collect()) == sorted(HISTORY)
    assert full.rdd.getNumPartitions() == 4
    asked()
    at = {s: "2026-01-03" for s, _, _ in HISTORY if s != "s6"}
    found = spark.read.format(name).option("mode", "incremental").option("cursors", json.dumps(at)).load().collect()
    # s0 and s3 end on the third; s6 has no cursor; of the others the last day is read again
    assert sorted(tuple(r) for r in found) == sorted(r for r in HISTORY if r[0] == "s6" or r[0] not in ("s0", "s3") and r[1] >= "2026-01-03")
    assert {w[0] for w in asked()} == {"s1", "s2", "s4", "s5", "s6"}
    with pytest.raises(Exception, match="neither full nor incremental"):
        spark.read.format(name).option("mode", "some").load().collect()


def run(spark, name, target, state):
    stream = spark.readStream.format(name).option("symbolsPerBatch", 3).option("symbolsPerTask", 2).load()
    ingest.upserting(stream, target, ["scode", "trade_date"], state).awaitTermination()


def test_a_stream_goes_on_behind_each_cursor(spark, provider, tmp_path):
    name, bars, tell, asked = provider
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for moved in (("s0", "s1", "s2"), ("s3", "s4", "s5"), ("s6",), ()):  # each run is a new process, stopped after three symbols
        run(spark, name, target, state)
        found = asked()
        assert {w[0] for w in found} == set(moved) and all(w[1] is None for w in found)
    assert sorted((r.scode, r.trade_date, r.close) for r in store.read_table(spark, target).collect()) == sorted(HISTORY)
    # a last day that is corrected, a later day, a new symbol, one that is listed without days, and one that is listed no more
    put(spark, bars, [("s0", "2026-01-04", 4.5), ("n", "2026-01-09", 1.0)])
    tell([("s0", "2026-01-04"), ("s1", "2026-01-04"), ("n", "2026-01-09"), ("none", None)])
    run(spark, name, target, state)
    assert {tuple(w) for w in asked()} == {("n", None, "2026-01-09"), ("s0", "2026-01-03", "2026-01-04")}  # an upsert reads its batch more than once
    after = sorted((r.scode, r.trade_date, r.close) for r in store.read_table(spark, target).collect())
    assert after == sorted([*HISTORY, ("s0", "2026-01-04", 4.5), ("n", "2026-01-09", 1.0)])


def test_a_batch_that_failed_is_read_again_alone(spark, provider, tmp_path):
    name, _, _, asked = provider
    state, seen = str(tmp_path / "state"), []

    def job(fail):
        def write(batch, number):
            rows = sorted(tuple(r) for r in batch.collect())
            if fail and number == 1:
                raise RuntimeError("lost")
            seen.extend(rows)

        return write

    def go(fail):
        stream = spark.readStream.format(name).option("symbolsPerBatch", 3).load()
        return ingest.recomputing(stream, job(fail), state)

    go(False).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        go(True).awaitTermination()
    asked()
    go(False).awaitTermination()
    assert {w[0] for w in asked()} >= {"s3", "s4", "s5"}
    for _ in range(2):
        go(False).awaitTermination()
    assert sorted(seen) == sorted(HISTORY)


def test_listings_and_bounds(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "listing")
    spark.createDataFrame([("a", "2026-01-02"), ("a", "2026-01-05"), ("b", None), (None, "2026-01-01")], "scode string, trade_date string").selectExpr("scode", "cast(trade_date as date) trade_date").write.parquet(path)
    assert cursors.listed(path)() == {"a": "2026-01-05", "b": None}
    assert cursors.behind({"a": "2026-01-05", "x": "2026-01-01"}, {"a": "2026-01-05", "b": None, "c": "2026-01-01"}) == [("c", None, "2026-01-01")]
    assert [len(r.wanted) for r in cursors.ranges([("a", None, "d")] * 5, 2)] == [2, 2, 1] and cursors.ranges([], 2)[0].wanted == ()
    monkeypatch.setattr(cursors, "MOST_SYMBOLS", 1)
    with pytest.raises(ValueError, match="join with stored cursors"):
        cursors.checked({"a": "d", "b": "d"})


def test_dates_as_days(spark, tmp_path):
    path = str(tmp_path / "dated")
    spark.createDataFrame(HISTORY, SCHEMA).selectExpr("scode", "cast(trade_date as date) trade_date", "close").write.parquet(path)
    fetch = cursors.parquet_fetch(path, ["scode", "trade_date", "close"])
    found = pa.Table.from_batches(list(fetch([("s1", "2026-01-02", "2026-01-03"), ("s2", None, "2026-01-01")])))
    assert sorted((s, str(d)) for s, d in zip(found["scode"].to_pylist(), found["trade_date"].to_pylist())) == [("s1", "2026-01-02"), ("s1", "2026-01-03"), ("s2", "2026-01-01")]

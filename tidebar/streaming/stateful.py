"""Streams with keyed state: months that close by event-time timers, daily selections under a limit and a cooldown, corrections found by content hashes.

Each gives what its batch operator gives, over any split of the input into batches: a month, or a day, is decided when the watermark has passed its
end, and rows that come later than the watermark are dropped by Spark and counted in the query's progress (`late_rows`). The state store must be RocksDB
(`with_state_store`), which keeps state out of the executors' heap.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidebar.functions.scalars import is_special_name
from tidebar.operators import bars as B
from tidebar.operators.portfolio import COOLDOWN
from tidebar.sources.scratch import released, stored
from tidebar.sources.store import exists, replace_slices

UTC = dt.timezone.utc


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the progress that the query remembers."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in json.loads(p.json if hasattr(p, "json") else json.dumps(p)).get("stateOperators", []))


def _ms(day: dt.date) -> int:
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)


# months


class Months(StatefulProcessor):
    """State of a symbol: its open months, one row each, however many bars they have."""

    FIELDS = ("first_day", "last_day", "open", "close", "high", "low", "volume", "amount")

    def init(self, handle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "month string", "first_day string, last_day string, open double, close double, high double, low double, volume double, amount double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame.dropna(subset=["ts", "open", "close", "high", "low", "volume"])
            for month, part in frame.groupby(frame["ts"].dt.strftime("%Y-%m")):
                part = part.sort_values("ts")
                new = (str(part["ts"].iloc[0]), str(part["ts"].iloc[-1]), float(part["open"].iloc[0]), float(part["close"].iloc[-1]), float(part["high"].max()), float(part["low"].min()), float(part["volume"].sum()), float(part["amount"].fillna(0).sum()))
                if self.months.containsKey((month,)):
                    old = self.months.getValue((month,))
                    first, last = (new if new[0] < old[0] else old), (new if new[1] > old[1] else old)
                    new = (first[0], last[1], first[2], last[3], max(old[4], new[4]), min(old[5], new[5]), old[6] + new[6], old[7] + new[7])
                else:
                    year, number = map(int, month.split("-"))
                    self.handle.registerTimer(_ms(dt.date(year + number // 12, number % 12 + 1, 1)))
                self.months.updateValue((month,), new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).strftime("%Y-%m")
        for (month,), row in sorted(self.months.iterator()):
            if month < end:
                self.months.removeKey((month,))
                yield pd.DataFrame({"scode": [key[0]], "trade_date": [pd.Timestamp(row[1]).date()], "open": [row[2]], "close": [row[3]], "high": [row[4]], "low": [row[5]], "volume": [row[6]], "amount": [row[7]]})

    def close(self) -> None:
        pass


def monthly_bars(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Monthly bars out of daily ones (scode, ts and prices), each emitted once, on its last bar's day, when the watermark has passed the month's end."""
    rows = stream.select("scode", "ts", *[F.col(c).cast("double").alias(c) for c in ("open", "close", "high", "low", "volume", "amount")]).withWatermark("ts", lateness)
    return rows.groupBy("scode").transformWithStateInPandas(
        statefulProcessor=Months(), outputStructType="scode string, trade_date date, open double, close double, high double, low double, volume double, amount double", outputMode="Append", timeMode="EventTime")


# selections


class DailyPicks(StatefulProcessor):
    """State of a strategy: the best candidates of the days that are still open, and when each resting symbol was chosen last; both are bounded."""

    def __init__(self, limit: int, cooldown: int):
        self.limit, self.cooldown = limit, cooldown

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int", "candidates string")
        self.chosen = handle.getMapState("chosen", "scode string", "day int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for scode, day in zip(initialState["scode"], initialState["day_index"]):
            if not self.chosen.containsKey((scode,)) or self.chosen.getValue((scode,))[0] < day:
                self.chosen.updateValue((scode,), (int(day),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, part in frame.groupby("day_index"):
                day = int(day)
                known = json.loads(self.open.getValue((day,))[0]) if self.open.containsKey((day,)) else {"date": str(part["trade_date"].iloc[0]), "rows": []}
                if not known["rows"]:
                    self.handle.registerTimer(_ms(dt.date.fromisoformat(known["date"]) + dt.timedelta(days=1)))
                both = known["rows"] + [[s, None if pd.isna(v) else float(v)] for s, v in zip(part["scode"], part["score"])]
                known["rows"] = _best(both, self.limit * (self.cooldown + 1))
                self.open.updateValue((day,), (json.dumps(known),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).date().isoformat()
        for (day,), (text,) in sorted(self.open.iterator()):
            known = json.loads(text)
            if known["date"] >= passed:
                continue
            last = {s: d for (s,), (d,) in self.chosen.iterator()}
            picks = [r for r in known["rows"] if r[0] not in last or day - last[r[0]] > self.cooldown][: self.limit]
            for scode, _ in picks:
                self.chosen.updateValue((scode,), (day,))
            for scode, d in last.items():
                if day - d > self.cooldown and scode not in {r[0] for r in picks}:
                    self.chosen.removeKey((scode,))
            self.open.removeKey((day,))
            if picks:
                yield pd.DataFrame({"strategy_name": key[0], "trade_date": dt.date.fromisoformat(known["date"]), "scode": [r[0] for r in picks], "score": [r[1] for r in picks]})

    def close(self) -> None:
        pass


def _best(rows: list[list], most: int) -> list[list]:
    """The best `most`, highest score first, unscored last, ties by symbol; a symbol that repeats counts once."""
    seen, out = set(), []
    for scode, score in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0])):
        if scode not in seen:
            seen.add(scode)
            out.append([scode, score])
    return out[:most]


def picked_signals(stream: DataFrame, calendar: DataFrame, limit: int, cooldown: int = COOLDOWN, lateness: str = "1 day", before: DataFrame | None = None) -> DataFrame:
    """strategy_name, trade_date, scode and score of the daily selections: `portfolio.selected` over a stream (strategy_name, sname, scode, trade_date, score).

    A day is decided when the watermark has passed it. A strategy is one key, as a day's choice depends on the days before, but only its best
    limit x (cooldown + 1) signals of a day can be chosen, and each task keeps no more than these before they meet. `before` has stored selections
    (strategy_name, scode, trade_date), from which symbols rest at the start.
    """
    days = F.broadcast(calendar.select("trade_date", F.col("day_index").cast("int").alias("day_index")))
    rows = stream.where(~is_special_name(F.col("sname"))).join(days, "trade_date")
    most = limit * (cooldown + 1)

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ordered = frame.sort_values(["score", "scode"], ascending=[False, True], na_position="last").drop_duplicates(["strategy_name", "day_index", "scode"])
            yield ordered.groupby(["strategy_name", "day_index"], sort=False).head(most)

    kept = rows.select("strategy_name", "scode", "trade_date", "day_index", F.col("score").cast("double").alias("score"))
    kept = kept.mapInPandas(trim, kept.schema).withColumn("ts", F.col("trade_date").cast("timestamp")).withWatermark("ts", lateness)
    first = before.join(days, "trade_date").select("strategy_name", "scode", "day_index").groupBy("strategy_name") if before is not None else None
    return kept.groupBy("strategy_name").transformWithStateInPandas(
        statefulProcessor=DailyPicks(limit, cooldown), outputStructType="strategy_name string, trade_date date, scode string, score double", outputMode="Append", timeMode="EventTime", initialState=first)


# corrections


class Corrections(StatefulProcessor):
    """State of a symbol: the content hash of each of its plans."""

    def init(self, handle) -> None:
        self.hashes = handle.getMapState("hashes", "plan string", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed = []
        for frame in rows:
            for plan, content in zip(frame["plan"], frame["content_hash"]):
                if self.hashes.containsKey((plan,)):
                    if self.hashes.getValue((plan,))[0] == content:
                        continue
                    changed.append(plan)
                self.hashes.updateValue((plan,), (content,))
        if changed:
            yield pd.DataFrame({"scode": [key[0]], "changed": [len(changed)]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def corrected_symbols(plans: DataFrame) -> DataFrame:
    """scode, and how many of its plans changed, of every symbol with a plan (scode, plan, content_hash) that came before with other content."""
    rows = plans.select("scode", F.col("plan").cast("string").alias("plan"), F.coalesce("content_hash", F.lit("")).alias("content_hash")).where("plan IS NOT NULL")
    return rows.groupBy("scode").transformWithStateInPandas(statefulProcessor=Corrections(), outputStructType="scode string, changed int", outputMode="Update", timeMode="None")


PARTS = 64


def _parted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("scode"), F.lit(PARTS)).cast("int"))


def write_bars(daily: DataFrame, path: str, today: str) -> None:
    """Daily, weekly and monthly bars as three tables under path, each in parts by a hash of the symbol."""
    for name, rows in _periods(daily, today):
        replace_slices(_parted(rows), f"{path}/{name}", ["part"])


def _periods(daily: DataFrame, today: str):
    return (("daily", daily), ("weekly", B.resample(daily, "W", today)), ("monthly", B.resample(daily, "M", today)))


def rebuild(changed: DataFrame, source: Callable[[DataFrame], DataFrame], path: str, today: str) -> None:
    """Replace the daily, weekly and monthly rows of the changed symbols alone: `source` gives their corrected daily bars.

    Only the parts that hold such a symbol are read and written; the new rows are stored before a part is overwritten, so a run that fails can be repeated.
    """
    spark = changed.sparkSession
    symbols = stored(changed.select("scode").distinct(), "symbols")
    touched = [r[0] for r in _parted(symbols).select("part").distinct().collect()]  # as many as there are parts at most
    if touched:
        fresh = stored(source(symbols).join(symbols, "scode", "left_semi"), "fresh")
        for name, rows in _periods(fresh, today):
            new = _parted(rows)
            if exists(spark, f"{path}/{name}"):
                old = spark.read.parquet(f"{path}/{name}").where(F.col("part").isin(touched))
                new = old.join(symbols, "scode", "left_anti").unionByName(new.select(*old.columns))
            whole = stored(new, name)
            replace_slices(whole, f"{path}/{name}", ["part"])
            released(whole)
        released(fresh)
    released(symbols)


def rebuilding(plans: DataFrame, source: Callable[[DataFrame], DataFrame], path: str, today: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of plans; each batch rebuilds the symbols whose plans it corrects."""
    def batch(changed: DataFrame, number: int) -> None:
        rebuild(changed, source, path, today)

    return corrected_symbols(plans).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

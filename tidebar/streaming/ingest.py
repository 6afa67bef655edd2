"""Incremental ingestion on Structured Streaming: bars by file offsets, weekly windows, cooldown as keyed state, upserts in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.sources.store import upsert

DAY = "1 day"


def fresh_bars(stream: DataFrame, lateness: str = "10 days") -> DataFrame:
    """Bars (scode, ts, ...) once each; what is later than the watermark is dropped, as rows behind the cursor are."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["scode", "ts"])


def weekly_bars(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Tumbling weeks from Saturday to Friday, emitted once they are over; a bar belongs to the Friday that ends its week."""
    weeks = stream.withWatermark("ts", lateness).groupBy("scode", F.window("ts", "7 days", "7 days", "2 days"))
    out = weeks.agg(F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    return out.select("scode", F.date_sub(F.to_date("window.end"), 1).alias("trade_date"), "open", "close", "high", "low", "volume", "amount")


def event_counts(stream: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in tumbling windows."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def cooled_signals(stream: DataFrame, gap: int) -> DataFrame:
    """Signals (scode, day_index) more than `gap` positions after the symbol's last one that was kept; the state is that one position."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for day in sorted(d for f in frames for d in f["day_index"]):
            if last is None or day - last > gap:
                last = int(day)
                kept.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"scode": [key[0]] * len(kept), "day_index": kept})

    return stream.groupBy("scode").applyInPandasWithState(keep, "scode string, day_index long", "last long", "append", GroupStateTimeout.NoTimeout)


def upserting(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Upsert what has arrived into a Parquet folder and end; run it again from a timer. A batch that repeats changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recomputing(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch job on every micro-batch, such as a rebuild of the symbols whose history has changed."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuilt(history: DataFrame, corrected: DataFrame) -> DataFrame:
    """History in which every symbol of the corrected rows has those rows alone."""
    return history.join(corrected.select("scode").distinct(), "scode", "left_anti").unionByName(corrected)

"""Forward evaluation of signals: entry bars, outcome windows, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalars import weighted_price

from .bars import along, asof_forward

#: Bars 3 to 8 after the entry; thresholds of success, explosion and failure.
FIRST, LAST = 3, 8
SUCCESS, EXPLOSIVE, FAILURE = 1.02, 1.20, 0.99


def forward_windows(bars: DataFrame) -> DataFrame:
    """Each bar with the aggregates of its outcome window (n bars in it), ready to be joined by (scode, trade_date)."""
    frame = along().rowsBetween(FIRST, LAST)
    total = {c: f(c).over(frame) for c, f in (("low", F.min), ("high", F.max), ("amount", F.sum), ("volume", F.sum))}
    typical = F.avg((F.col("high") + F.col("low") + F.col("close")) / 3).over(frame)
    rows = bars.select("scode", "trade_date", F.count("*").over(frame).alias("n"), *[c.alias(f"w_{k}") for k, c in total.items()], F.avg("close").over(frame).alias("w_close"), typical.alias("w_typical"))
    price = weighted_price(F.col("w_amount"), F.col("w_volume"), F.col("w_low"), F.col("w_high"), F.col("w_close"), F.col("w_typical"))
    return rows.select("scode", "trade_date", "n", F.col("w_low").alias("min_low"), price.alias("average_price"))


def evaluate(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcomes of signals (scode, trade_date, close): the entry is the bar of the day or the next one; a signal needs the whole window."""
    entries = asof_forward(signals, bars.select("scode", "trade_date", F.col("trade_date").alias("entry_date")), ["entry_date"])
    windows = forward_windows(bars).withColumnRenamed("trade_date", "entry_date")
    joined = entries.join(windows, ["scode", "entry_date"]).where((F.col("n") == LAST - FIRST + 1) & (F.col("close") > 0))
    return joined.withColumns({
        "success": F.col("min_low") >= SUCCESS * F.col("close"), "explosive": F.col("min_low") >= EXPLOSIVE * F.col("close"),
        "failure": F.col("average_price") <= FAILURE * F.col("close"), "rise_rate": F.col("min_low") / F.col("close") - 1, "drop_rate": F.col("average_price") / F.col("close") - 1,
    }).drop("n")


def rate(flag: str) -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))


def mean(value: str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def _measures() -> list[Column]:
    return [
        F.count("*").alias("sample_count"), rate("success").alias("success_rate"), mean("rise_rate").alias("avg_rise_rate"), rate("failure").alias("failure_rate"),
        mean("drop_rate").alias("avg_drop_rate"), rate("explosive").alias("explosive_rate"),
    ]


def summary(outcomes: DataFrame) -> DataFrame:
    """One row, zeros without outcomes."""
    return outcomes.agg(*_measures())


def by_stock(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("scode").agg(*_measures())


def by_selection(outcomes: DataFrame) -> DataFrame:
    """One row for each signal, flags as 1.0 and 0.0."""
    return outcomes.select(
        "scode", "trade_date", F.lit(1).cast("long").alias("sample_count"), F.col("success").cast("double").alias("success_rate"), F.col("rise_rate").alias("avg_rise_rate"),
        F.col("failure").cast("double").alias("failure_rate"), F.col("drop_rate").alias("avg_drop_rate"), F.col("explosive").cast("double").alias("explosive_rate"))


def evaluate_weekly(signals: DataFrame) -> DataFrame:
    """Weekly signals count as successes with rates of zero."""
    return signals.withColumns({"success": F.lit(True), "explosive": F.lit(False), "failure": F.lit(False), "rise_rate": F.lit(0.0), "drop_rate": F.lit(0.0)})

"""Event labels from the bars that follow, and what is excluded around events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import along, asof_backward, with_index, with_leads
from .mentions import stock_mentions


def surge_events(bars: DataFrame, start: str, end: str, first: str | None = None, last: str | None = None, ahead: int = 3, gain: float = 0.20) -> DataFrame:
    """Days from start to end whose close rises by `gain` until `ahead` bars later; two earlier bars of the loaded range are needed.

    The range [first, last] is cut before positions are counted.
    """
    if first:
        bars = bars.where(F.col("trade_date") >= F.lit(first).cast("date"))
    if last:
        bars = bars.where(F.col("trade_date") <= F.lit(last).cast("date"))
    w = along()
    rows = bars.select("scode", F.col("trade_date").alias("start_rise_date"), "close", *[F.lag("trade_date", i).over(w).alias(n) for i, n in ((1, "prev_trade_date"), (2, "selection_date"))], F.lead("close", ahead).over(w).alias("later"))
    rows = rows.where(F.col("start_rise_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("selection_date").isNotNull() & (F.col("close") > 0))
    return rows.withColumn("gain_rate", F.col("later") / F.col("close") - 1).where(F.col("gain_rate") >= gain).select("scode", "start_rise_date", "prev_trade_date", "selection_date", "gain_rate")


def threeclass_labels(bars: DataFrame, steps: int = 3, up: float = 1.20, down: float = 0.94) -> DataFrame:
    """The first trigger among the next bars: positive, negative; discard where one bar has both; neutral without any. All bars ahead are needed."""
    rows = with_leads(bars, steps=steps)
    label = F.lit("neutral")
    for i in range(steps, 0, -1):
        rises, falls = F.col(f"high_{i}") >= up * F.col("close"), F.col(f"low_{i}") <= down * F.col("close")
        label = F.when(rises & falls, "discard").when(rises, "positive").when(falls, "negative").otherwise(label)
    whole = F.col(f"high_{steps}").isNotNull() & F.col(f"low_{steps}").isNotNull() & (F.col("close") > 0)
    return rows.where(whole).select("scode", "trade_date", "close", label.alias("label"))


def forward_low(bars: DataFrame, steps: int = 3) -> DataFrame:
    """min_low of the next bars, null unless all are there."""
    frame = along().rowsBetween(1, steps)
    return bars.withColumn("min_low", F.when(F.count("low").over(frame) == steps, F.min("low").over(frame)))


def near_positions(rows: DataFrame, marks: DataFrame, distance: int) -> DataFrame:
    """Rows (scode, trade_index) within `distance` positions of a mark of their symbol: each mark spreads to its positions, then an equal join."""
    spread = marks.select("scode", F.explode(F.sequence(F.col("trade_index") - distance, F.col("trade_index") + distance)).alias("trade_index")).distinct()
    return rows.join(spread, ["scode", "trade_index"], "left_semi")


def far_positions(rows: DataFrame, marks: DataFrame, distance: int) -> DataFrame:
    spread = marks.select("scode", F.explode(F.sequence(F.col("trade_index") - distance, F.col("trade_index") + distance)).alias("trade_index")).distinct()
    return rows.join(spread, ["scode", "trade_index"], "left_anti")


def drop6_labels(bars: DataFrame, drop: float = 0.06, steps: int = 3, exclusion: int = 10) -> DataFrame:
    """Label 1 where the lowest low ahead is 6 percent under the close; label 0 elsewhere, but not within `exclusion` bars of a label 1."""
    rows = with_index(forward_low(bars, steps)).where("min_low IS NOT NULL AND close > 0")
    rows = rows.withColumn("drop_rate", (F.col("min_low") - F.col("close")) / F.col("close"))
    ones = rows.where(F.col("drop_rate") <= -drop)
    zeros = far_positions(rows.where(F.col("drop_rate") > -drop), ones, exclusion)
    keep = ["scode", "trade_date", "trade_index", "drop_rate"]
    return ones.select(*keep, F.lit(1).alias("label")).unionByName(zeros.select(*keep, F.lit(0).alias("label")))


def down6_neutral_labels(bars: DataFrame, steps: int = 3, up: float = 1.20, down: float = 0.94, exclusion: int = 20) -> DataFrame:
    """down6 where the lowest low ahead falls to 0.94 of the close; surges are left out, and so is what lies within 20 bars of one; else neutral."""
    rows = with_index(with_leads(bars, steps=steps)).where(f"high_{steps} IS NOT NULL AND close > 0")
    lows, highs = F.least(*[f"low_{i}" for i in range(1, steps + 1)]), F.greatest(*[f"high_{i}" for i in range(1, steps + 1)])
    kind = F.when(lows <= down * F.col("close"), "down6").when(highs >= up * F.col("close"), "surge").otherwise("neutral")
    rows = rows.select("scode", "trade_date", "trade_index", kind.alias("label"))
    neutral = far_positions(rows.where("label = 'neutral'"), rows.where("label = 'surge'"), exclusion)
    return rows.where("label = 'down6'").unionByName(neutral)


def classify_anchors(anchors: DataFrame, bars: DataFrame, drop: float = 0.06, steps: int = 3) -> DataFrame:
    """Anchors (scode, trade_date) with is_drop6; false where the bar is missing or too few follow."""
    flags = forward_low(bars, steps).select("scode", "trade_date", ((F.col("min_low") - F.col("close")) / F.col("close") <= -drop).alias("__flag"))
    return anchors.join(flags, ["scode", "trade_date"], "left").withColumn("is_drop6", F.coalesce("__flag", F.lit(False))).drop("__flag")


def selection_backfill(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events with the symbol's last bar day strictly before prev_trade_date."""
    named = events.withColumn("trade_date", F.col("prev_trade_date"))
    days = bars.select("scode", "trade_date", F.col("trade_date").alias("selection_date"))
    return asof_backward(named, days, ["selection_date"], strict=True).drop("trade_date")


def told_by_news(events: DataFrame, news: DataFrame, keywords: list[str], days: int = 3) -> DataFrame:
    """Events (scode, sname, selection_date) of which news within `days` calendar days tells, by name or code and a keyword.

    News without a keyword is left out first; the stocks that the rest names are found in one scan of each text, and each mention spreads to the
    days around it, so the join is by stock and day.
    """
    text = F.concat_ws(" ", "title", "summary")
    told = F.lit(False)
    for k in keywords:
        told = told | F.contains(text, F.lit(k))
    dated = news.where(told).select(F.to_date("publish_time").alias("day"), text.alias("text")).where("day IS NOT NULL")
    named = stock_mentions(dated, events.select("scode", "sname").distinct())
    near = named.select("scode", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("selection_date")).distinct()
    return events.select("scode", "selection_date").distinct().join(near, ["scode", "selection_date"], "left_semi")


def without_news(events: DataFrame, news: DataFrame, keywords: list[str], days: int = 3) -> DataFrame:
    return events.join(told_by_news(events, news, keywords, days), ["scode", "selection_date"], "left_anti")

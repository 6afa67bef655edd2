"""Scans: ranges with the history that windows need, days with a fallback, events, stored patterns, predictions and pools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import asof_backward, latest_rows


def between(bars: DataFrame, start: str, end: str, before: int = 0, after: int = 0, symbols: list[str] | None = None) -> DataFrame:
    """Bars from `before` days ahead of start to `after` days behind end, both included; of some symbols where they are named. Filters reach the scan."""
    rows = bars.where(F.col("trade_date").between(F.date_sub(F.lit(start).cast("date"), before), F.date_add(F.lit(end).cast("date"), after)))
    return rows.where(F.col("scode").isin(symbols)) if symbols is not None else rows


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("scode").distinct().orderBy("scode")


def zero_filled(bars: DataFrame) -> DataFrame:
    """Numbers without nulls and days as YYYYMMDD, as sample windows take them."""
    numbers = [f.name for f in bars.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return bars.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in numbers} | {"day": F.date_format("trade_date", "yyyyMMdd")})


def news_days(days: DataFrame, news: DataFrame) -> DataFrame:
    """Each day (trade_date) with news_date: the day itself or, without news on it, the last day before that has some."""
    seen = news.select(F.lit("all").alias("k"), F.to_date("publish_time").alias("trade_date")).distinct().withColumn("news_date", F.col("trade_date"))
    return asof_backward(days.select(F.lit("all").alias("k"), "trade_date"), seen, ["news_date"], key="k").drop("k")


def news_window(news: DataFrame, first: str, last: str, days: int) -> DataFrame:
    day = F.to_date("publish_time")
    return news.where(day.between(F.date_sub(F.lit(first).cast("date"), days), F.date_add(F.lit(last).cast("date"), days)))


def positive_events(events: DataFrame, start: str, end: str) -> DataFrame:
    """scode and trade_date of surge events: the selection day, or the previous trading day where there is none."""
    day = F.coalesce("selection_date", "prev_trade_date")
    return events.select("scode", day.alias("trade_date"), "gain_rate").where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def stored_patterns(patterns: DataFrame, least_rate: float, start: str | None = None, end: str | None = None) -> DataFrame:
    """The best row of each pattern's text among those that reach the rate (and were tested in the range)."""
    rows = patterns.where(F.col("success_rate") >= least_rate)
    for column, bound in (("start_date", start), ("end_date", end)):
        if bound:
            rows = rows.where(F.col(column) == F.lit(bound).cast("date"))
    return latest_rows(rows, ["pattern"], [F.desc("success_rate"), F.desc("success_count"), F.desc("sample_count")])


def prediction_signals(predictions: DataFrame, stocks: DataFrame) -> DataFrame:
    """Saved predictions (trade_date, strategy_name, rank_no, scode, probability) as signals, with names and a reason."""
    reason = F.left(F.concat(F.lit("rank="), F.col("rank_no").cast("string"), F.lit("; probability="), F.round("probability", 4).cast("string")), F.lit(255))
    return predictions.join(stocks.select("scode", "sname"), "scode", "left").select("trade_date", "scode", "sname", F.col("probability").alias("score"), reason.alias("reason"), "strategy_name", "rank_no")


def saved_predictions(scored: DataFrame, strategy: str, threshold: float) -> DataFrame:
    """Rank numbers of each day's rows that reach the threshold."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("trade_date").orderBy(F.desc("probability"), "scode")
    return scored.where(F.col("probability") >= threshold).select("trade_date", F.lit(strategy).alias("strategy_name"), F.row_number().over(w).alias("rank_no"), "scode", "probability")


def pool_from(kind: str, spark: SparkSession, path: str) -> DataFrame:
    """A stock pool (trade_date, scode, score) from selections, predictions, earlier portfolios or CSV files with date and code columns."""
    if kind not in POOLS:
        raise ValueError(f"unknown pool {kind}")
    return POOLS[kind](spark, path)


def _csv_pool(spark: SparkSession, path: str) -> DataFrame:
    from tidebar.functions.scalars import lenient_date, normalize_symbol

    raw = spark.read.option("header", "true").csv(path)
    known = {c.strip().lower(): c for c in raw.columns}
    day, code = (next((known[a] for a in names if a in known), None) for names in (("trade_date", "tradedate", "date", "日期"), ("scode", "code", "symbol", "代码")))
    if day is None or code is None:
        raise ValueError("a pool needs a date and a code column")
    score = F.col(known["score"]).try_cast("double") if "score" in known else F.lit(None).cast("double")
    return raw.select(lenient_date(F.col(day)).alias("trade_date"), normalize_symbol(F.col(code)).alias("scode"), score.alias("score")).where("trade_date IS NOT NULL").dropDuplicates(["trade_date", "scode"])


POOLS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stockselection": lambda s, p: s.read.parquet(p).select("trade_date", "scode", "score"),
    "blackbox_predictions": lambda s, p: s.read.parquet(p).select("trade_date", "scode", F.col("probability").alias("score")),
    "portfolio_backtest": lambda s, p: s.read.parquet(p).where("side = 'BUY'").select(F.col("selection_date").alias("trade_date"), "scode", F.lit(None).cast("double").alias("score")).distinct(),
    "csv": _csv_pool,
}


def with_scores(rows: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ("scode", "trade_date")) -> DataFrame:
    """rows with their score, minus infinity where there is none; for an order, sort by score, so that missing ones come last."""
    return rows.join(scores.select(*keys, "score"), list(keys), "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def overlap(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("scode", "trade_date")) -> DataFrame:
    """How many keys both have."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("n"))


def set_fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """A digest of a set of texts that does not depend on their order: equal sets have equal ones."""
    hashes = rows.select(column).distinct().select(F.xxhash64(column).cast("decimal(38,0)").alias("h"))
    return hashes.agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("digest"))


def split_loader(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of train and test folders with their split; a folder `all` alone is the test split."""
    from tidebar.sources.store import exists, read_jsonl

    parts = [read_jsonl(spark, f"{path}/{s}", schema).withColumn("split", F.lit(s)) for s in ("train", "test") if exists(spark, f"{path}/{s}")]
    parts = parts or [read_jsonl(spark, f"{path}/all", schema).withColumn("split", F.lit("test"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

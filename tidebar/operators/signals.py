"""Rule-based stock signals with one output contract: trade_date, scode, close, score, reason, strategy_name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.scalars import two_decimals
from tidebar.sources.scratch import stored

from .bars import along, latest_day, moving_averages, with_changes

CONTRACT = ("trade_date", "scode", "close", "score", "reason", "strategy_name")
MA_BULLISH, WEEKLY_DROP, NEWS_HOT, SURGE_PATTERN = "ma_bullish_v1", "weekly_volume_drop_v1", "news_hot_v1", "llm_surge_pattern_v1"


def percent_text(c: Column) -> Column:
    return F.concat(two_decimals(c * 100), F.lit("%"))


def ma_bullish(bars: DataFrame, least_amount: float = 0.0, most_change: float = 0.095) -> DataFrame:
    """Averages in falling order under a rising close, enough turnover, no limit-up; score is the distance to the longest average."""
    rows = with_changes(moving_averages(bars))
    ordered = (F.col("ma5") > F.col("ma8")) & (F.col("ma8") > F.col("ma13")) & (F.col("ma13") > F.col("ma34")) & (F.col("ma34") > F.col("ma55"))
    good = ordered & (F.col("close") > F.col("ma5")) & (F.col("close") > F.col("open")) & (F.col("avg_amount5") >= least_amount) & (F.col("pct_change") < most_change)
    found = rows.where(good & (F.col("ma55") > 0)).withColumn("score", F.col("close") / F.col("ma55") - 1)
    reason = F.left(F.concat(F.lit("ma_bullish distance="), percent_text(F.col("score"))), F.lit(255))
    return found.select("trade_date", "scode", "close", "amount", "score", reason.alias("reason"), F.lit(MA_BULLISH).alias("strategy_name"))


def weekly_volume_drop(weeks: DataFrame, least_ratio: float = 1.5, least_drop: float = 0.15) -> DataFrame:
    """Two falling weeks by 15 percent in all, whose mean volume is 1.5 times that of the five weeks before."""
    w = along()
    rows = weeks.withColumns({
        "c1": F.lag("close", 1).over(w), "c2": F.lag("close", 2).over(w), "n": F.row_number().over(w),
        "base": F.avg("volume").over(w.rowsBetween(-7, -3)), "recent": F.avg("volume").over(w.rowsBetween(-1, 0)),
    })
    drop, ratio = F.col("close") / F.col("c2") - 1, F.col("recent") / F.col("base")
    found = rows.where((F.col("n") >= 8) & (F.col("close") < F.col("c1")) & (F.col("c1") < F.col("c2")) & (F.col("base") > 0) & (F.col("c2") > 0))
    found = found.withColumns({"drop": drop, "ratio": ratio}).where((F.col("ratio") >= least_ratio) & (F.col("drop") <= -least_drop))
    score = 0.7 * F.abs("drop") + 0.3 * F.least(F.col("ratio") / least_ratio, F.lit(3.0))
    reason = F.concat(F.lit("weekly_volume_drop drop="), percent_text(F.col("drop")))
    return found.select("trade_date", "scode", "close", score.alias("score"), reason.alias("reason"), F.lit(WEEKLY_DROP).alias("strategy_name"))


def performance_score(bars: DataFrame) -> DataFrame:
    """Clipped 5- and 20-day returns and turnover."""
    w = along()
    rows = with_changes(bars).withColumns({"c5": F.lag("close", 5).over(w), "c20": F.lag("close", 20).over(w)})

    def clipped(past: str, low: float, high: float) -> Column:
        change = F.when(F.col(past) > 0, F.col("close") / F.col(past) - 1)
        return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(change, F.lit(0.0))))

    turnover = F.when(F.col("avg_amount5") > 0, F.least(F.col("avg_amount5") / 100000, F.lit(1.0))).otherwise(F.lit(0.0))
    return rows.select("scode", "trade_date", (clipped("c5", -0.10, 0.20) + 0.5 * clipped("c20", -0.15, 0.30) + 0.2 * turnover).alias("performance"))


def top_per_day(signals: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The k best of each day with their rank; ties by symbol."""
    w = Window.partitionBy("trade_date").orderBy(*(order or [F.col("score").desc_nulls_last(), F.col("scode")]))
    return signals.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def selection(signals: DataFrame, stocks: DataFrame, limit: int | None = None) -> DataFrame:
    """Signals as selections of seven columns, names included, by score and amount; the first `limit` of them."""
    amount = F.col("amount") if "amount" in signals.columns else F.lit(None).cast("double")
    named = signals.withColumn("__amount", amount).join(stocks.select("scode", "sname"), "scode", "left")
    out = named.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("__amount"), "scode").select("trade_date", "scode", "sname", "close", "score", "reason", "strategy_name")
    return out.limit(limit) if limit else out


def merged(streams: list[DataFrame], k: int | None = None) -> DataFrame:
    """Signals of several strategies in one contract; at most k of each strategy and day."""
    out = streams[0].select(*CONTRACT)
    for s in streams[1:]:
        out = out.unionByName(s.select(*CONTRACT))
    if k:
        w = Window.partitionBy("strategy_name", "trade_date").orderBy(F.col("score").desc_nulls_last(), "scode")
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    return out


def news_hot_signals(daily: DataFrame, news: DataFrame, stocks: DataFrame, concepts: Mapping[str, Sequence[str]] | None = None, day: str | None = None, least: int = 3, most: int = 5) -> DataFrame:
    """Bars of one day (the last, if none is named) whose stocks the news tells of, by news and performance: max(least, min(most, n)) of them."""
    from . import news as N

    words = N.CONCEPT_KEYWORDS if concepts is None else concepts
    current = daily.where(F.col("trade_date") == F.lit(day).cast("date")) if day else daily.join(F.broadcast(latest_day(daily)), "trade_date")  # one row
    named = stocks.join(current.select("scode"), "scode", "left_semi")
    scores = N.stock_scores(news, named, N.concept_heat(news), words)
    performance = performance_score(daily).join(current.select("scode", "trade_date"), ["scode", "trade_date"], "left_semi").drop("trade_date")
    found = current.join(scores, "scode").join(performance, "scode", "left")
    score = 0.65 * F.col("news_score") + 0.35 * F.coalesce("performance", F.lit(0.0))
    reason = F.left(F.concat(F.lit("news_hot; concepts="), F.coalesce("hot_concepts", F.lit(""))), F.lit(255))
    found = found.select("trade_date", "scode", "close", "amount", score.alias("score"), reason.alias("reason"), F.lit(NEWS_HOT).alias("strategy_name"))
    return found.orderBy(F.desc("score"), F.desc_nulls_last("amount"), "scode").limit(max(least, most))


def surge_pattern_signals(daily: DataFrame, weekly: DataFrame, patterns: DataFrame, day: str | None = None, least_rate: float = 0.35, least_samples: int = 20, least_support: int = 5, least_threshold: float = 0.25) -> DataFrame:
    """Bars (of one day, if it is named) that stored patterns of any size match: the best by success rate, samples and support tells the score.

    patterns: pattern, min_success_rate, success_rate, sample_count and positive_support; one that is stored for several thresholds counts once.
    """
    from . import features as X
    from . import itemsets
    from . import patterns as P

    good = patterns.where((F.col("success_rate") >= least_rate) & (F.col("sample_count") >= least_samples) & (F.col("positive_support") >= least_support) & (F.col("min_success_rate") >= least_threshold))
    order = F.struct("success_rate", "sample_count", "positive_support")
    good = good.groupBy("pattern").agg(F.max(order).alias("o")).select("pattern", "o.*").where(F.size(P.parse_pattern(F.col("pattern"))) > 0)
    # a number for each pattern, the best first, so that the bars aggregate integers; patterns are rules, whose number follows the vocabulary and not the bars
    best_first = Window.orderBy(F.desc("success_rate"), F.desc("sample_count"), F.desc("positive_support"), "pattern")
    good = stored(good.withColumn("place", F.row_number().over(best_first)), "patterns")
    rows = X.packed(daily, weekly)
    if day:
        rows = rows.where(F.col("trade_date") == F.lit(day).cast("date"))
    wanted = good.select("place", P.parse_pattern(F.col("pattern")).alias("pattern_items")).orderBy("place")
    few = P.listed(wanted)
    if few is None:
        hits = itemsets.divided(P.with_tokens(rows).select("scode", "trade_date", "tokens"), wanted, "tokens")
        told = hits.groupBy("scode", "trade_date").agg(F.min("place").alias("place"), F.count("*").alias("pattern_count")).join(good, "place")
    else:  # all are numbered and hold tokens, so a pattern's place in the list is its number
        told = P.first_matches(rows, few).withColumn("place", F.col("place") + 1).join(F.broadcast(good), "place")
    rate = F.col("success_rate")
    reason = F.left(F.concat(F.lit("patterns="), F.col("pattern_count"), F.lit(" best="), F.col("pattern"), F.lit(" success="), percent_text(rate), F.lit(" failure="), percent_text(1 - rate), F.lit(" sample="), F.col("sample_count")), F.lit(255))
    found = told.join(daily.select("scode", "trade_date", "close"), ["scode", "trade_date"])
    return found.select("trade_date", "scode", "close", F.col("pattern_count").cast("double").alias("amount"), rate.alias("score"), reason.alias("reason"), F.lit(SURGE_PATTERN).alias("strategy_name"))


#: Strategy names and how each makes signals from daily and weekly bars and the inputs that it asks for by name.
STRATEGIES = {
    MA_BULLISH: lambda daily, weekly, **_: ma_bullish(daily),
    WEEKLY_DROP: lambda daily, weekly, **_: weekly_volume_drop(weekly),
    NEWS_HOT: lambda daily, weekly, *, news, stocks, concepts=None, day=None, **_: news_hot_signals(daily, news, stocks, concepts, day),
    SURGE_PATTERN: lambda daily, weekly, *, patterns, day=None, **_: surge_pattern_signals(daily, weekly, patterns, day),
}


def run_strategy(name: str, daily: DataFrame, weekly: DataFrame, **inputs) -> DataFrame:
    """Signals of a strategy by name. news_hot_v1 also needs news and stocks, llm_surge_pattern_v1 patterns; both take a day."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}")
    return STRATEGIES[name](daily, weekly, **inputs).select(*CONTRACT)


def strategy_selection(name: str, daily: DataFrame, weekly: DataFrame, stocks: DataFrame, limit: int | None = None, **inputs) -> DataFrame:
    """The seven columns of a selection, names included, by any strategy."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}")
    return selection(STRATEGIES[name](daily, weekly, stocks=stocks, **inputs), stocks, limit)

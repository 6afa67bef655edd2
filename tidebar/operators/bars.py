"""Bars: windows along a symbol, resampling, calendars, cursors, as-of joins. Everything is partitioned by symbol and ordered by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

PERIODS = (5, 8, 13, 34, 55)


def along(order: str = "trade_date", key: str = "scode") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def rolling_mean(column: str, rows: int, w: WindowSpec | None = None) -> Column:
    """Mean of the last rows; null until there are that many values."""
    frame = (w or along()).rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(frame) == rows, F.avg(column).over(frame))


def moving_averages(bars: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    return bars.withColumns({f"ma{n}": rolling_mean("close", n) for n in periods})


def with_changes(bars: DataFrame) -> DataFrame:
    """prev_close, pct_change and avg_amount5."""
    w = along()
    out = bars.withColumns({"prev_close": F.lag("close").over(w), "avg_amount5": rolling_mean("amount", 5)})
    return out.withColumn("pct_change", F.when(F.col("prev_close") > 0, F.col("close") / F.col("prev_close") - 1))


def with_index(bars: DataFrame) -> DataFrame:
    """trade_index: the bar's place in its symbol, from 0."""
    return bars.withColumn("trade_index", F.row_number().over(along()) - 1)


def with_leads(bars: DataFrame, columns: tuple[str, ...] = ("high", "low"), steps: int = 3) -> DataFrame:
    w = along()
    return bars.withColumns({f"{c}_{i}": F.lead(c, i).over(w) for c in columns for i in range(1, steps + 1)})


def resample(bars: DataFrame, period: str, today: str, include_current: bool = False) -> DataFrame:
    """Weekly bars that end on Friday (weekends belong to the next week), or monthly ones on the month's last bar; only periods that are over.

    Bars with a null price, volume or day are left out; amounts that are all null sum to 0.
    """
    # as one test, of which no part is pushed below the bars: their exchange stays the same for days and weeks
    whole = bars.where(~F.array_contains(F.array(*[F.col(c).isNull() for c in ("trade_date", "open", "close", "high", "low", "volume")]), True))
    if period == "W":
        ends = F.next_day(F.date_sub("trade_date", 1), "FRI")
    elif period == "M":
        ends = F.last_day("trade_date")
    else:
        raise ValueError("period is W or M")
    out = whole.groupBy("scode", ends.alias("period_end")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max_by("close", "trade_date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), F.max("trade_date").alias("last_day"))
    end = F.greatest("period_end", "last_day")  # the period's end, in a form that is not pushed below the bars either
    if period == "W":
        return out.where(end <= F.lit(today).cast("date")).withColumnRenamed("period_end", "trade_date").drop("last_day")
    this = F.trunc(F.lit(today).cast("date"), "month")
    over = end < this
    if include_current:
        over = over | (F.trunc(end, "month") == this)
    return out.where(over).drop("period_end").withColumnRenamed("last_day", "trade_date")


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should name every tie."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def ordinals(rows: DataFrame, bucket: Column, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their place from 0 in an order that begins with `bucket` (a day, a symbol, a rounded score; a few rows for each are enough).

    Rows are counted by bucket, only these counts are added up in one task, and a window numbers the rows of each bucket.
    """
    marked = rows.withColumn("__bucket", bucket)
    counts = marked.groupBy(F.col("__bucket").alias("__of")).agg(F.count("*").alias("__count"))
    before = F.coalesce(F.sum("__count").over(Window.orderBy(F.asc_nulls_first("__of")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__of", before.alias("__before"))
    placed = marked.withColumn(name, F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1)
    joined = placed.join(offsets, F.col("__bucket").eqNullSafe(F.col("__of")))
    return joined.withColumn(name, F.col("__before") + F.col(name)).drop("__bucket", "__of", "__before")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "scode", order: str = "trade_date") -> DataFrame:
    """Incoming rows after the key's last stored one; of repeated (key, order) the last by all columns stays."""
    cursor = stored.groupBy(key).agg(F.max(order).alias("__cursor"))
    fresh = incoming.join(cursor, key, "left").where(F.col("__cursor").isNull() | (F.col(order) > F.col("__cursor"))).drop("__cursor")
    return latest_rows(fresh, [key, order], [F.col(c).desc() for c in fresh.columns if c not in (key, order)])


def cursors(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Each stock with the day of its last bar, null without any."""
    return stocks.join(bars.groupBy("scode").agg(F.max("trade_date").alias("latest")), "scode", "left")


def calendar(bars: DataFrame) -> DataFrame:
    """Trading days with their index from 0, and whether they end their month. A row for each day, so one window orders them."""
    days = bars.select("trade_date").distinct()
    w = Window.orderBy("trade_date")
    following = F.lead("trade_date").over(w)
    return days.select("trade_date", (F.row_number().over(w) - 1).alias("day_index"), F.coalesce(F.month(following) != F.month("trade_date"), F.lit(True)).alias("ends_month"))


def latest_day(bars: DataFrame) -> DataFrame:
    """The last trading day. Raises an error when it is evaluated without any bar."""
    found = F.max("trade_date")
    return bars.agg(F.when(found.isNull(), F.raise_error(F.lit("there are no bars")).cast("date")).otherwise(found).alias("trade_date"))


def latest_day_or_none(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("trade_date").alias("trade_date"))


def abnormal_symbols(stocks: DataFrame, bars: DataFrame, days: int = 10) -> DataFrame:
    """Delisted by name, or without a bar since the market's (days + 1)-th last day."""
    from tidebar.functions.scalars import is_delisted_name

    cutoff = bars.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(days + 1).agg(F.min("trade_date").alias("cutoff"))
    last = cursors(stocks, bars)
    return last.crossJoin(F.broadcast(cutoff)).where(is_delisted_name(F.col("sname")) | F.col("latest").isNull() | (F.col("latest") < F.col("cutoff"))).select("scode", "sname", "latest")


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], key: str = "scode", order: str = "trade_date", strict: bool = False) -> DataFrame:
    """left with the values of the last right row of its key at or before its day (before, if strict): one union and one window, no range join."""
    kept = [c for c in left.columns if c not in (key, order)]
    first, second = (0, 1) if strict else (1, 0)
    a = left.select(key, order, F.lit(first).alias("__side"), *kept, *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values], F.lit(False).alias("__right"))
    b = right.select(key, order, F.lit(second).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept], *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__right"))
    w = Window.partitionBy(key).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.union(b).withColumn("__seen", F.last(F.when(F.col("__right"), F.struct(*[F.col(f"__{v}").alias(v) for v in values])), ignorenulls=True).over(w))
    return seen.where(~F.col("__right")).select(key, order, *kept, *[F.col("__seen")[v].alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, values: list[str], key: str = "scode", order: str = "trade_date", strict: bool = False) -> DataFrame:
    """left with the values of the first right row of its key at or after its day (after, if strict)."""
    kept = [c for c in left.columns if c not in (key, order)]
    first, second = (1, 0) if strict else (0, 1)
    a = left.select(key, order, F.lit(first).alias("__side"), *kept, *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values], F.lit(False).alias("__right"))
    b = right.select(key, order, F.lit(second).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept], *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__right"))
    # backwards in time, so that the frame grows row by row; one that ends at the last row would be read again for each row
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.union(b).withColumn("__seen", F.last(F.when(F.col("__right"), F.struct(*[F.col(f"__{v}").alias(v) for v in values])), ignorenulls=True).over(w))
    return seen.where(~F.col("__right")).select(key, order, *kept, *[F.col("__seen")[v].alias(v) for v in values])


def changed_rows(incoming: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Incoming rows whose key is new or whose digest differs from the stored one; null keys match null keys."""
    old = stored.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"), F.lit(True).alias("__known"))
    joined = incoming.join(old, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.where(F.col("__known").isNull() | ~F.col(digest).eqNullSafe(F.col("__digest"))).select(incoming.columns)

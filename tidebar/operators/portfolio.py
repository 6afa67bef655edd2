"""A cash-constrained T+1 portfolio: which signals are bought, what each day does, and what trades earn.

A signal has its buying bar and the three bars after it, which is all that a position ever sees; what it would sell under each rule is a column of its
row. Sequential is cash from day to day alone: a fold of each rule says which signals are bought, and trades, holdings and days are made of these.
The folds are bounded by the calendar and the daily limit, not by the data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.scalars import STOP_LOSSES, bar_price, is_special_name, lot_shares, round_cent, stable_rank

from .bars import along, asof_forward
from .datasets import cooldown

#: Money and rates.
CASH, BUDGET, FEE, STAMP = 1_000_000.0, 100_000.0, 0.0002, 0.0005
COOLDOWN = 13


def selected(signals: DataFrame, calendar: DataFrame, cooldown_days: int = COOLDOWN, limit: int | None = None) -> DataFrame:
    """Signals without specially treated names, days outside the calendar, and symbols chosen in the last `cooldown_days` trading days.

    Without a limit every symbol is folded on its own. With a daily limit, what is chosen depends on the days before; at most limit x cooldown
    symbols rest at any time, so the best limit x (cooldown + 1) of each day decide, and the fold sees no more rows than that.
    """
    rows = signals.where(~is_special_name(F.col("sname"))).join(F.broadcast(calendar.select("trade_date", "day_index")), "trade_date")
    if limit is None:
        best = rows.withColumn("__n", F.row_number().over(Window.partitionBy("scode", "trade_date").orderBy(F.desc_nulls_last("score")))).where("__n = 1").drop("__n")
        return cooldown(best, cooldown_days, "day_index").drop("day_index")
    w = Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("score"), "scode")
    near = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit * (cooldown_days + 1))
    keep = near.select("strategy_name", "trade_date", "day_index", "scode", F.col("__n").cast("int").alias("n"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, int] = {}
        chosen = []
        for day, group in frame.sort_values(["day_index", "n"]).groupby("day_index", sort=True):
            today = 0
            for i, scode in zip(group.index, group["scode"]):
                if today < limit and (scode not in last or day - last[scode] > cooldown_days):
                    last[scode] = day
                    today += 1
                    chosen.append(i)
        return frame.loc[chosen, ["strategy_name", "trade_date", "scode"]]

    kept = keep.groupBy("strategy_name").applyInPandas(fold, "strategy_name string, trade_date date, scode string")
    return near.drop("__n", "day_index").join(kept, ["strategy_name", "trade_date", "scode"], "left_semi")


def schedule(signals: DataFrame, bars: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Signals with their buying bar (the first after the signal), price, shares, and `path`: the three bars after it."""
    w = along()
    priced = bars.withColumn("price", bar_price()).withColumn("shares", lot_shares(budget, F.col("price")))
    later = F.array_compact(F.array(*[F.lead(F.struct("trade_date", "open", "high", "low", "close")).over(w) if i == 1 else F.lead(F.struct("trade_date", "open", "high", "low", "close"), i).over(w) for i in (1, 2, 3)]))
    rows = priced.select("scode", "trade_date", F.col("trade_date").alias("buy_date"), "price", "shares", F.col("close").alias("buy_close"), later.alias("path"))
    dated = signals.withColumn("selection_date", F.col("trade_date"))
    return asof_forward(dated, rows, ["buy_date", "price", "shares", "buy_close", "path"], strict=True).where("shares > 0")


def stops(loss: Column, cost: Column, bar: Column) -> Column:
    """The stop that a bar sets off: price and reason, or null. The first of its tests that holds counts: the open, then the low, then the close."""
    whole = F.concat(two_places(loss * 100), F.lit("pct"))
    deep, shallow, at = round_cent(cost * 0.95), round_cent(cost * 0.97), round_cent(cost * (1 - loss))

    def hit(price: Column, reason: Column) -> Column:
        return F.struct(price.alias("price"), reason.alias("reason"))

    three = F.when(bar["open"] <= deep, hit(round_cent(bar["open"]), F.lit("gap_open_stop_loss_5pct"))).when(bar["low"] <= deep, hit(deep, F.lit("intraday_stop_loss_5pct"))).when(
        bar["close"] <= shallow, hit(round_cent(bar["close"]), F.lit("close_stop_loss_3pct")))
    other = F.when(bar["open"] <= at, hit(round_cent(bar["open"]), F.concat(F.lit("gap_open_stop_loss_"), whole))).when(bar["low"] <= at, hit(at, F.concat(F.lit("stop_loss_"), whole)))
    return F.when(F.abs(loss - 0.03) < 1e-12, three).otherwise(other)


def two_places(c: Column) -> Column:
    """A number without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")


def exits() -> Column:
    """What a position sells on its bars: an array of day, shares, price and reason. Columns rule, price, shares and path (the bars after the buying one).

    A stop sells all and ends the bar's day. Else half goes at 10 percent, once, the rest at 20 percent, and what is left at the close of the third bar.
    """
    cost, original = F.col("price"), F.col("shares").cast("long")
    sale = "struct<day:date,shares:bigint,price:double,reason:string>"

    def sold(day: Column, shares: Column, price: Column, reason: Column) -> Column:
        return F.array(F.struct(day.alias("day"), shares.cast("long").alias("shares"), price.alias("price"), reason.alias("reason")).cast(sale))

    none = F.array().cast(f"array<{sale}>")

    def step(state: Column, bar: Column) -> Column:
        left, day = state["left"], bar["trade_date"]
        stop = stops(F.col("rule"), cost, bar)
        half = F.when(~state["halved"] & (bar["high"] >= round_cent(cost * 1.10)), F.least(left, F.greatest(F.lit(1).cast("long"), F.floor(original / 2).cast("long")))).otherwise(F.lit(0).cast("long"))
        rest = left - half
        top = F.when((rest > 0) & (bar["high"] >= round_cent(cost * 1.20)), rest).otherwise(F.lit(0).cast("long"))
        last = F.when((rest - top > 0) & (bar["elapsed"] >= 3), rest - top).otherwise(F.lit(0).cast("long"))
        sales = F.concat(
            F.when(half > 0, sold(day, half, round_cent(cost * 1.10), F.lit("take_profit_10pct_half"))).otherwise(none),
            F.when(top > 0, sold(day, top, round_cent(cost * 1.20), F.lit("take_profit_20pct_remaining"))).otherwise(none),
            F.when(last > 0, sold(day, last, round_cent(bar["close"]), F.lit("time_exit_day3_close"))).otherwise(none))
        stopped = F.struct(F.lit(0).cast("long").alias("left"), state["halved"].alias("halved"), F.concat(state["sold"], sold(day, left, stop["price"], stop["reason"])).alias("sold"))
        going = F.struct((rest - top - last).alias("left"), (state["halved"] | (half > 0)).alias("halved"), F.concat(state["sold"], sales).alias("sold"))
        return F.when(left <= 0, state).when(stop.isNotNull(), stopped).otherwise(going)

    bars = F.transform("path", lambda b, i: F.struct((i + 1).alias("elapsed"), *[b[c].alias(c) for c in ("trade_date", "open", "high", "low", "close")]))
    begin = F.struct(original.alias("left"), F.lit(False).alias("halved"), none.alias("sold"))
    return F.aggregate(bars, begin, step, lambda s: s["sold"])


def positions(scheduled: DataFrame, rules: Sequence[float] = STOP_LOSSES, fee_rate: float = FEE, stamp_rate: float = STAMP, seed: int = 7) -> DataFrame:
    """A row for each rule and scheduled signal: what it would cost, what it would sell, and how it would be marked, if it is bought.

    None of this depends on cash, so it is computed for each row alone. sales: day, shares, price, reason, gross, fee (stamp included) and stamp; marks: day and
    close of the bars from the buying one on.
    """
    series = scheduled.sparkSession.createDataFrame([(float(r),) for r in rules], "rule double")
    rows = scheduled.crossJoin(F.broadcast(series)).withColumn("sales", exits())  # a row for each rule

    def taxed(sale: Column) -> Column:
        gross = sale["shares"] * sale["price"]
        stamp = round_cent(gross * stamp_rate)
        return F.struct(*[sale[c].alias(c) for c in ("day", "shares", "price", "reason")], gross.alias("gross"), (round_cent(gross * fee_rate) + stamp).alias("fee"), stamp.alias("stamp"))

    marks = F.concat(F.array(F.struct(F.col("buy_date").alias("day"), F.col("buy_close").alias("close"))), F.transform("path", lambda b: F.struct(b["trade_date"].alias("day"), b["close"].alias("close"))))
    gross = F.col("shares") * F.col("price")
    return rows.select(
        "rule", "scode", "selection_date", "buy_date", "price", F.col("shares").cast("long").alias("shares"), gross.alias("gross"), round_cent(gross * fee_rate).alias("fee"),
        stable_rank(seed, F.col("scode"), F.col("selection_date")).alias("hash_rank"), F.transform("sales", taxed).alias("sales"), marks.alias("marks"))


def bought(planned: DataFrame, days: DataFrame, end: str, cash: float = CASH) -> DataFrame:
    """The positions that a rule's cash allows: rule, scode, selection_date, and last_day, the last one that the rule's run reaches.

    Cash of a day follows from that of the day before, so a rule's days are one fold. It sees a few numbers of each position: as many rows as the calendar
    has days times the daily limit of the signals, whatever the size of the market. Each day sells, then buys in hash order, each within cash and
    within a third of the portfolio's value; after `end` days only go on while something is held or due.
    """
    kept = planned.select("rule", "scode", "selection_date", "buy_date", "price", "shares", "gross", "fee", "hash_rank", F.to_json("sales").alias("sales"), F.to_json("marks").alias("marks"))
    listed = days.agg(F.array_sort(F.collect_list(F.col("trade_date").cast("string"))).alias("days"))  # a date for each trading day

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        due: dict[str, list[dict]] = {}
        for r in frame.sort_values(["hash_rank", "scode", "selection_date"]).to_dict("records"):
            due.setdefault(str(r["buy_date"]), []).append(r)
        money, held, out, last = cash, [], [], None
        for day in frame["days"].iloc[0]:
            if day > end and not held and day not in due:
                break
            last = day
            for p in held:
                for sale in p["sales_by_day"].get(day, ()):
                    money += sale["gross"] - sale["fee"]
                    p["left"] -= sale["shares"]
            held = [p for p in held if p["left"] > 0]
            cap, used = max(0.0, min(money, (money + sum(p["left"] * p["closes"].get(day, p["price"]) for p in held)) / 3)), 0.0
            for r in due.get(day, ()):
                total = r["gross"] + r["fee"]
                if total > money or used + total > cap:
                    continue
                money, used = money - total, used + total
                sales: dict[str, list[dict]] = {}
                for sale in json.loads(r["sales"]):
                    sales.setdefault(sale["day"], []).append(sale)
                held.append(r | {"left": r["shares"], "sales_by_day": sales, "closes": {m["day"]: m["close"] for m in json.loads(r["marks"])}})
                out.append((r["rule"], r["scode"], r["selection_date"]))
        found = pd.DataFrame(out, columns=["rule", "scode", "selection_date"])
        return found.assign(last_day=pd.Timestamp(last).date() if last else None)

    return kept.crossJoin(F.broadcast(listed)).groupBy("rule").applyInPandas(run, "rule double, scode string, selection_date date, last_day date")


def simulate(scheduled: DataFrame, days: DataFrame, end: str, rules: Sequence[float] = STOP_LOSSES, cash: float = CASH, fee_rate: float = FEE, stamp_rate: float = STAMP, seed: int = 7) -> DataFrame:
    """The positions that are bought under each rule, with their sales and marks; trades(), holdings() and daily() are made of them. days: trade_date of the
    trading days from the start on; end: the last day on which buying is not a must for going on (YYYY-MM-DD)."""
    planned = positions(scheduled, rules, fee_rate, stamp_rate, seed)
    return planned.join(bought(planned, days, end, cash), ["rule", "scode", "selection_date"])


def trades(held: DataFrame) -> DataFrame:
    """Buys and sells of simulated positions, up to the last day of the run."""
    keys = ["rule", "scode", "selection_date"]
    buys = held.select(*keys, F.col("buy_date").alias("trade_date"), F.lit("BUY").alias("side"), "shares", "price", "gross", "fee", F.lit(0.0).alias("stamp"), F.lit("next_day_average_entry").alias("reason"))
    sold = held.select(*keys, "last_day", F.explode("sales").alias("s")).where(F.col("s.day") <= F.col("last_day"))
    sells = sold.select(*keys, F.col("s.day").alias("trade_date"), F.lit("SELL").alias("side"), *[F.col(f"s.{c}").alias(c) for c in ("shares", "price", "gross", "fee", "stamp", "reason")])
    return buys.unionByName(sells).select("rule", "trade_date", "scode", "selection_date", "side", "shares", "price", "gross", "fee", "stamp", "reason")


def holdings(held: DataFrame, days: DataFrame) -> DataFrame:
    """Shares and value of each position at the end of each trading day on which it is held; without a bar that day it is worth what it cost."""
    over = F.aggregate("sales", F.lit(0).cast("long"), lambda a, s: a + s["shares"]) >= F.col("shares")
    until = F.when(over, F.date_sub(F.array_max(F.transform("sales", lambda s: s["day"])), 1)).otherwise(F.col("last_day"))
    rows = held.withColumn("day", F.explode(F.sequence("buy_date", F.greatest(F.least(until, F.col("last_day")), F.col("buy_date")))))
    rows = rows.join(F.broadcast(days.select(F.col("trade_date").alias("day"))), "day")  # a date for each trading day
    left = F.col("shares") - F.aggregate(F.filter("sales", lambda s: s["day"] <= F.col("day")), F.lit(0).cast("long"), lambda a, s: a + s["shares"])
    close = F.coalesce(F.get(F.transform(F.filter("marks", lambda m: m["day"] == F.col("day")), lambda m: m["close"]), F.lit(0)), F.col("price"))
    return rows.select("rule", F.col("day").alias("trade_date"), "scode", "selection_date", left.alias("shares"), close.alias("price"), (left * close).alias("value")).where("shares > 0")


def daily(held: DataFrame, days: DataFrame, cash: float = CASH) -> DataFrame:
    """Cash, value and turnover of each rule on each trading day of its run: cash is what was there first and all that came and went since."""
    span = held.groupBy("rule").agg(F.max("last_day").alias("last_day")).crossJoin(F.broadcast(days.select("trade_date"))).where("trade_date <= last_day").select("rule", "trade_date")
    moved = trades(held).groupBy("rule", "trade_date").agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("gross")).otherwise(0.0)).alias("bought"), F.sum(F.when(F.col("side") == "SELL", F.col("gross")).otherwise(0.0)).alias("sold"), F.sum("fee").alias("fee"))
    worth = holdings(held, days).groupBy("rule", "trade_date").agg(F.sum("value").alias("holding"), F.count("*").cast("int").alias("positions"))
    rows = span.join(moved, ["rule", "trade_date"], "left").join(worth, ["rule", "trade_date"], "left").na.fill(0.0, ["bought", "sold", "fee", "holding"]).na.fill(0, ["positions"])
    # a row for each rule and trading day
    so_far = Window.partitionBy("rule").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cash", cash + F.sum(F.col("sold") - F.col("bought") - F.col("fee")).over(so_far))
    return rows.select("rule", "trade_date", "cash", "holding", (F.col("cash") + F.col("holding")).alias("total"), "bought", "sold", "fee", "positions")


def tracked(predictions: DataFrame, bars: DataFrame, rules: Sequence[float] = STOP_LOSSES) -> DataFrame:
    """Each prediction (scode, trade_date) as if it alone were bought, under each rule: buying day and price, shares sold so far, what they brought after fees,
    the part of the cost that came back with them, and the return on it; null before anything is sold."""
    planned = positions(schedule(predictions, bars), rules)

    def total(of: Column) -> Column:
        return F.aggregate("sales", F.lit(0.0), lambda a, s: a + of(s))

    sold, brought = total(lambda s: s["shares"].cast("double")), total(lambda s: s["gross"] - s["fee"])
    spent = (F.col("gross") + F.col("fee")) * sold / F.col("shares")
    return planned.select("rule", "scode", "selection_date", "buy_date", "price", "shares", sold.cast("long").alias("sold"), brought.alias("brought"), F.when(sold > 0, brought / spent - 1).alias("return_rate"),
                          F.when(sold >= F.col("shares"), F.element_at("sales", -1)["reason"]).alias("closed_by"))


def pool_run(pool_rows: DataFrame, bars: DataFrame, days: DataFrame, end: str, limit: int, rules: Sequence[float] = STOP_LOSSES) -> DataFrame:
    """A pool (trade_date, scode, score) limited to its best rows of each day, scheduled and simulated; nothing is written."""
    w = Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("score"), "scode")
    chosen = pool_rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).select("scode", "trade_date", "score")
    return simulate(schedule(chosen, bars), days, end, rules)


def realized(trades: DataFrame, order: list[str], keys: tuple[str, ...] = ("scode", "selection_date")) -> DataFrame:
    """Sells with buy_cost, buy_fee and realized_pnl, first in first out.

    The shares of a key are numbered on both sides. The last numbers of all buys and sells cut them into stretches, each of which belongs to one buy and
    one sell at most: the next ones that end there or later, which a window finds from the end. So a key costs as many rows as it has trades.
    """
    side = Window.partitionBy(*keys, "side").orderBy(*order)
    ends = trades.withColumn("__end", F.sum("shares").over(side.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__seq", F.row_number().over(side))
    sells = F.struct("__seq", *[c for c in trades.columns if c not in keys])
    points = ends.select(*keys, "__end", "side", "__seq", F.when(F.col("side") == "BUY", F.struct("price", (F.col("fee") / F.col("shares")).alias("fee"))).alias("__buy"), F.when(F.col("side") == "SELL", sells).alias("__sell"))
    back = Window.partitionBy(*keys).orderBy(F.desc("__end"), F.desc("side"), F.desc("__seq"))
    seen = back.rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("__end") - F.coalesce(F.lead("__end").over(back), F.lit(0))
    met = points.select(*keys, length.alias("__n"), F.last("__buy", ignorenulls=True).over(seen).alias("__buy"), F.last("__sell", ignorenulls=True).over(seen).alias("__sell")).where("__sell IS NOT NULL")

    def total(of: str) -> Column:
        return F.coalesce(F.sum(F.col("__n") * F.col(f"__buy.{of}")), F.lit(0.0))

    out = met.groupBy(*keys, "__sell").agg(total("price").alias("buy_cost"), total("fee").alias("buy_fee")).select(*keys, "__sell.*", "buy_cost", "buy_fee").drop("__seq")
    return out.select(*trades.columns, "buy_cost", "buy_fee", (F.col("gross") - F.col("fee") - F.col("buy_cost") - F.col("buy_fee")).alias("realized_pnl"))


def pool(signals: DataFrame) -> DataFrame:
    """Signals of several rules as one pool: first day, name and number of rules of each selection."""
    return signals.groupBy("selection_date", "scode").agg(F.min("trade_date").alias("trade_date"), F.max("sname").alias("sname"), F.count_distinct("rule").alias("rules"))


def reason_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("side", "reason").agg(F.count("*").alias("n"))

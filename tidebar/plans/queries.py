"""Registered queries over the derived views, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import backtest, bars, features, labels, patterns, signals
from tidebar.sources import derived
from tidebar.sources.derived import BARS_SQL, NEWS_SQL, STOCKS_SQL, TODAY

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Days between which events are looked for: all that the views can have.
START, END = "1900-01-01", TODAY
W = "PARTITION BY scode ORDER BY trade_date"

WEEKLY_SQL = f"""weekly AS (
    SELECT scode, CAST(trade_date + to_days(CAST((5 - isodow(trade_date) + 7) % 7 AS INTEGER)) AS DATE) AS week_end,
           arg_min(open, trade_date) AS open, arg_max(close, trade_date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume, coalesce(sum(amount), 0) AS amount
    FROM bars GROUP BY 1, 2 HAVING week_end <= DATE '{TODAY}'),
weeks AS (SELECT scode, week_end AS trade_date, open, close, high, low, volume, amount FROM weekly)"""


def mean_sql(column: str, rows: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {rows} THEN avg({column}) {frame} END"


MA_SQL = ", ".join(f"{mean_sql('close', n)} AS ma{n}" for n in bars.PERIODS)


def nudged(sql: str) -> str:
    """SQL in which round(x, n) is of x plus a thousandth of its last digit, so that ties fall alike in every engine."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, comma, i = 1, None, m.end()
        while depth:
            depth += {"(": 1, ")": -1, "[": 1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = sql[comma + 1 : i - 1].strip() if comma else ""
        if digits.isdigit():
            out.append(f"{sql[at : m.end()]}({sql[m.end() : comma]}) + 1e-{int(digits) + 3}, {digits})")
            at = i
    return "".join(out) + sql[at:]


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = nudged(sql)
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 10.0 ** -(digits + 3), digits) for c in columns})


def daily(spark: SparkSession, d: str) -> DataFrame:
    return derived.bars_daily(spark, d)


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return bars.resample(daily(spark, d), "W", TODAY)


@query(f"WITH {BARS_SQL} SELECT scode, trade_date, round(open, 6) AS open, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, volume, amount FROM bars")
def bars_daily(spark, d):
    return rounded(daily(spark, d), "open", "close", "high", "low")


@query(f"WITH {BARS_SQL}, {WEEKLY_SQL} SELECT scode, trade_date, round(open, 6) AS open, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, volume, round(amount, 4) AS amount FROM weeks")
def bars_weekly(spark, d):
    return rounded(rounded(weekly(spark, d), "open", "close", "high", "low"), "amount", digits=4).select("scode", "trade_date", "open", "close", "high", "low", "volume", "amount")


@query(f"""WITH {BARS_SQL} SELECT scode, max(trade_date) AS trade_date, round(arg_min(open, trade_date), 6) AS open, round(arg_max(close, trade_date), 6) AS close, round(max(high), 6) AS high,
    round(min(low), 6) AS low, sum(volume) AS volume, round(coalesce(sum(amount), 0), 4) AS amount FROM bars WHERE date_trunc('month', trade_date) < date_trunc('month', DATE '{TODAY}') GROUP BY scode, date_trunc('month', trade_date)""")
def bars_monthly(spark, d):
    out = bars.resample(daily(spark, d), "M", TODAY)
    return rounded(rounded(out, "open", "close", "high", "low"), "amount", digits=4)


@query(f"WITH {BARS_SQL} SELECT scode, trade_date, " + ", ".join(f"round({mean_sql('close', n)}, 6) AS ma{n}" for n in bars.PERIODS) + " FROM bars")
def ma_windows(spark, d):
    names = [f"ma{n}" for n in bars.PERIODS]
    return rounded(bars.moving_averages(daily(spark, d)), *names).select("scode", "trade_date", *names)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1""")
def dedupe_latest(spark, d):
    rows = derived.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return bars.latest_rows(rows, ["l_orderkey", "l_linenumber"], [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]).drop("l_shipdate")


@query(f"""WITH {BARS_SQL}, old AS (SELECT scode, max(trade_date) AS cursor FROM bars WHERE trade_date < DATE '2001-06-01' AND scode NOT LIKE '%7' GROUP BY 1)
    SELECT b.scode, b.trade_date, round(close, 6) AS close FROM bars b LEFT JOIN old USING (scode) WHERE cursor IS NULL OR b.trade_date > cursor""")
def incremental_new_rows(spark, d):
    b = daily(spark, d)
    stored = b.where("trade_date < DATE '2001-06-01' AND scode NOT LIKE '%7'")
    return rounded(bars.new_rows(b, stored).select("scode", "trade_date", "close"), "close")


SIGNALS_SQL = f"""changed AS (SELECT *, lag(close) OVER ({W}) AS prev_close, {mean_sql('amount', 5)} AS avg_amount5, {MA_SQL} FROM bars),
    bullish AS (SELECT trade_date, scode, close, amount, close / ma55 - 1 AS score FROM changed WHERE ma5 > ma8 AND ma8 > ma13 AND ma13 > ma34 AND ma34 > ma55 AND close > ma5 AND close > open
        AND avg_amount5 >= 0 AND prev_close > 0 AND close / prev_close - 1 < 0.095 AND ma55 > 0)"""


@query(f"WITH {BARS_SQL}, {SIGNALS_SQL} SELECT trade_date, scode, round(close, 6) AS close, round(score, 6) AS score, 'ma_bullish_v1' AS strategy_name FROM bullish")
def ma_bullish_signals(spark, d):
    return rounded(signals.ma_bullish(daily(spark, d)), "close", "score").select("trade_date", "scode", "close", "score", "strategy_name")


@query(f"""WITH {BARS_SQL}, {SIGNALS_SQL} SELECT trade_date, scode, round(score, 6) AS score, n AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, scode) AS n FROM bullish) WHERE n <= 2""")
def ma_bullish_topk_per_day(spark, d):
    return rounded(signals.top_per_day(signals.ma_bullish(daily(spark, d)), 2), "score").select("trade_date", "scode", "score", F.col("rank_no").cast("long").alias("rank_no"))


@query(f"""WITH {BARS_SQL}, {WEEKLY_SQL}, x AS (SELECT *, lag(close, 1) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2, row_number() OVER ({W}) AS n,
        avg(volume) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING) AS base, avg(volume) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS recent FROM weeks)
    SELECT trade_date, scode, round(close, 6) AS close, round(0.7 * abs(close / c2 - 1) + 0.3 * least(recent / base / 1.5, 3.0), 6) AS score FROM x
    WHERE n >= 8 AND close < c1 AND c1 < c2 AND base > 0 AND c2 > 0 AND recent / base >= 1.5 AND close / c2 - 1 <= -0.15""")
def weekly_volume_drop(spark, d):
    return rounded(signals.weekly_volume_drop(weekly(spark, d)), "close", "score").select("trade_date", "scode", "close", "score")


PERFORMANCE_SQL = f"""perf AS (SELECT scode, trade_date, greatest(-0.10, least(0.20, coalesce(CASE WHEN c5 > 0 THEN close / c5 - 1 END, 0.0))) + 0.5 * greatest(-0.15, least(0.30, coalesce(CASE WHEN c20 > 0 THEN close / c20 - 1 END, 0.0)))
        + 0.2 * (CASE WHEN a5 > 0 THEN least(a5 / 100000, 1.0) ELSE 0.0 END) AS performance
    FROM (SELECT *, lag(close, 5) OVER ({W}) AS c5, lag(close, 20) OVER ({W}) AS c20, {mean_sql('amount', 5)} AS a5 FROM bars))"""


@query(f"WITH {BARS_SQL}, {PERFORMANCE_SQL} SELECT scode, trade_date, round(performance, 6) AS performance FROM perf")
def performance_score(spark, d):
    return rounded(signals.performance_score(daily(spark, d)), "performance")


FORWARD_SQL = f"""fw AS (SELECT scode, trade_date, count(*) OVER f AS n, min(low) OVER f AS lo, max(high) OVER f AS hi, sum(amount) OVER f AS am, sum(volume) OVER f AS vo, avg(close) OVER f AS ac, avg((high + low + close) / 3) OVER f AS ty
        FROM bars WINDOW f AS ({W} ROWS BETWEEN 3 FOLLOWING AND 8 FOLLOWING)),
    fp AS (SELECT scode, trade_date AS entry_date, n, lo AS min_low, CASE WHEN ok1 AND (NOT ok2 OR abs(p1 - ac) <= abs(p2 - ac)) THEN p1 WHEN ok2 THEN p2 ELSE ty END AS average_price FROM (
        SELECT *, coalesce(p1 > 0 AND p1 >= l AND p1 <= h, false) AS ok1, coalesce(p2 > 0 AND p2 >= l AND p2 <= h, false) AS ok2 FROM (
        SELECT *, CASE WHEN vo > 0 THEN am * 100 / vo END AS p1, CASE WHEN vo > 0 THEN am * 10000 / vo END AS p2, CASE WHEN lo > 0 THEN 0.8 * lo ELSE 0 END AS l, CASE WHEN hi > 0 THEN 1.2 * hi ELSE 1e300 END AS h FROM fw))),
    outcomes AS (SELECT s.scode, s.trade_date, s.close, min_low, average_price, min_low >= 1.02 * s.close AS success, min_low >= 1.20 * s.close AS explosive, average_price <= 0.99 * s.close AS failure, min_low / s.close - 1 AS rise, average_price / s.close - 1 AS fall
        FROM bullish s JOIN fp ON fp.scode = s.scode AND fp.entry_date = s.trade_date WHERE n = 6)"""
RATES_SQL = "count(*) AS sample_count, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(avg(rise), 6) AS avg_rise_rate, round(avg(CAST(failure AS DOUBLE)), 6) AS failure_rate, round(avg(fall), 6) AS avg_drop_rate, round(avg(CAST(explosive AS DOUBLE)), 6) AS explosive_rate"
RATES = ("success_rate", "avg_rise_rate", "failure_rate", "avg_drop_rate", "explosive_rate")


def outcomes(spark, d):
    b = daily(spark, d)
    return backtest.evaluate(signals.ma_bullish(b).select("scode", "trade_date", "close"), b)


@query(f"WITH {BARS_SQL}, {SIGNALS_SQL}, {FORWARD_SQL} SELECT scode, trade_date, round(min_low, 6) AS min_low, round(average_price, 6) AS average_price, success, explosive, failure FROM outcomes")
def forward_outcomes(spark, d):
    return rounded(outcomes(spark, d), "min_low", "average_price").select("scode", "trade_date", "min_low", "average_price", "success", "explosive", "failure")


@query(f"WITH {BARS_SQL}, {SIGNALS_SQL}, {FORWARD_SQL} SELECT {RATES_SQL} FROM outcomes")
def backtest_summary(spark, d):
    return rounded(backtest.summary(outcomes(spark, d)), *RATES)


@query(f"WITH {BARS_SQL}, {SIGNALS_SQL}, {FORWARD_SQL} SELECT scode, {RATES_SQL} FROM outcomes GROUP BY scode")
def backtest_by_stock(spark, d):
    return rounded(backtest.by_stock(outcomes(spark, d)), *RATES)


@query(f"""WITH {BARS_SQL}, {SIGNALS_SQL}, {FORWARD_SQL} SELECT scode, trade_date, CAST(1 AS BIGINT) AS sample_count, CAST(success AS DOUBLE) AS success_rate, round(rise, 6) AS avg_rise_rate, CAST(failure AS DOUBLE) AS failure_rate,
    round(fall, 6) AS avg_drop_rate, CAST(explosive AS DOUBLE) AS explosive_rate FROM outcomes""")
def backtest_by_selection(spark, d):
    return rounded(backtest.by_selection(outcomes(spark, d)), "avg_rise_rate", "avg_drop_rate")


SURGE_SQL = f"""surges AS (SELECT scode, trade_date AS start_rise_date, p1 AS prev_trade_date, p2 AS selection_date, later / close - 1 AS gain_rate FROM (
        SELECT *, lag(trade_date, 1) OVER ({W}) AS p1, lag(trade_date, 2) OVER ({W}) AS p2, lead(close, 3) OVER ({W}) AS later FROM bars)
    WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}' AND p2 IS NOT NULL AND close > 0 AND later / close - 1 >= 0.20)"""


@query(f"WITH {BARS_SQL}, {SURGE_SQL} SELECT scode, start_rise_date, prev_trade_date, selection_date, round(gain_rate, 6) AS gain_rate FROM surges")
def surge_events(spark, d):
    return rounded(labels.surge_events(daily(spark, d), START, END), "gain_rate")


NEWS_WORDS = ("the", "der", "les")


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, {NEWS_SQL},
    words AS (SELECT CAST(publish_time AS DATE) AS day, title || ' ' || summary || CASE WHEN doc_id % 3 = 0 THEN '代码' || lpad(CAST(doc_id % 10 AS VARCHAR), 6, '0') || '。' ELSE '' END AS text FROM news),
    told AS (SELECT DISTINCT day, scode FROM words JOIN stocks ON contains(text, sname) OR contains(text, scode) WHERE contains(text, 'the') OR contains(text, 'der') OR contains(text, 'les'))
    SELECT b.scode, b.trade_date AS selection_date FROM bars b JOIN stocks USING (scode) WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.scode = b.scode AND t.day BETWEEN b.trade_date - 3 AND b.trade_date + 3)""")
def surge_message_filter(spark, d):
    events = daily(spark, d).select("scode", F.col("trade_date").alias("selection_date")).join(derived.stocks(spark, d).select("scode", "sname"), "scode")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("代码"), F.lpad((F.col("doc_id") % 10).cast("string"), 6, "0"), F.lit("。"))).otherwise("")
    told = derived.news(spark, d).withColumn("summary", F.concat("summary", code))
    return labels.without_news(events, told, list(NEWS_WORDS)).select("scode", "selection_date")


@query(f"""WITH {BARS_SQL}, {SURGE_SQL} SELECT s.scode, s.start_rise_date, max(b.trade_date) AS selection_date FROM surges s LEFT JOIN bars b ON b.scode = s.scode AND b.trade_date < s.prev_trade_date GROUP BY 1, 2""")
def selection_date_backfill(spark, d):
    b = daily(spark, d)
    events = labels.surge_events(b, START, END).drop("selection_date")
    return labels.selection_backfill(events, b).select("scode", "start_rise_date", "selection_date")


@query(f"""WITH {BARS_SQL}, {WEEKLY_SQL} SELECT b.scode, b.trade_date, w.trade_date AS week_end, round(w.close, 6) AS week_close FROM bars b ASOF LEFT JOIN weeks w ON b.scode = w.scode AND b.trade_date >= w.trade_date""")
def weekly_asof(spark, d):
    b = daily(spark, d)
    weeks = bars.resample(b, "W", TODAY).select("scode", "trade_date", F.col("trade_date").alias("week_end"), F.round("close", 6).alias("week_close"))
    return bars.asof_backward(b.select("scode", "trade_date"), weeks, ["week_end", "week_close"])


def tokens_sql(view: str, kind: dict, out: str) -> str:
    """The token rules as SQL over a view of bars."""
    p, (recent, base), high = kind["p"], kind["volume"], kind["high"]
    steps = [n for n in kind["returns"] if n < features.WINDOW]
    columns = [f"lag(close, {n}) OVER ({W}) AS past_{n}" for n in steps]
    frame = f"OVER ({W} ROWS BETWEEN {{}} PRECEDING AND {{}})"
    columns += [f"row_number() OVER ({W}) AS place", f"max(high) {frame.format(55, 'CURRENT ROW')} AS top", f"min(low) {frame.format(55, 'CURRENT ROW')} AS bottom",
                f"avg(volume) {frame.format(recent - 1, 'CURRENT ROW')} AS v1", f"avg(volume) {frame.format(recent + base - 1, f'{recent} PRECEDING')} AS v2", MA_SQL]
    rules = [f"CASE WHEN close > ma{n} THEN '{p}_CLOSE_GT_MA{n}' WHEN close <= ma{n} THEN '{p}_CLOSE_LE_MA{n}' END" for n in (5, 13, 34, 55)]
    rules += [f"CASE WHEN ma{a} > ma{b} THEN '{p}_MA{a}_GT_MA{b}' WHEN ma{a} <= ma{b} THEN '{p}_MA{a}_LE_MA{b}' END" for a, b in ((5, 13), (13, 34), (34, 55))]
    for n in steps:
        r = f"close / past_{n} - 1"
        arms = " ".join(f"WHEN past_{n} > 0 AND {r} {test} THEN '{p}_RET_{n}_{name}'" for test, name in ((">= 0.20", "GE_20"), (">= 0.10", "GE_10"), (">= 0.05", "GE_5"), ("<= -0.15", "LE_-15"), ("<= -0.08", "LE_-8"), ("IS NOT NULL", "RANGE_-8_5")))
        rules.append(f"CASE {arms} END")
    arms = " ".join(f"WHEN v2 > 0 AND v1 / v2 {test} THEN '{p}_VOL_RATIO_{name}'" for test, name in ((">= 2", "GE_2"), (">= 1.5", "GE_1_5"), ("<= 0.7", "LE_0_7"), ("IS NOT NULL", "NORMAL")))
    rules.append(f"CASE {arms} END")
    rules.append(f"CASE WHEN close >= 0.95 * top THEN '{p}_CLOSE_NEAR_{high}_HIGH' ELSE '{p}_CLOSE_NOT_NEAR_{high}_HIGH' END")
    rules.append(f"CASE WHEN close >= (top + bottom) / 2 THEN '{p}_CLOSE_ABOVE_{high}_MID' ELSE '{p}_CLOSE_BELOW_{high}_MID' END")
    if p == "D":
        columns += [f"avg((high - low) / close) {frame.format(9, 'CURRENT ROW')} AS r1", f"avg((high - low) / close) {frame.format(29, '10 PRECEDING')} AS r2"]
        rules.append("CASE WHEN r2 > 0 AND r1 <= 0.8 * r2 THEN 'D_RANGE_10_CONTRACT' WHEN r2 > 0 THEN 'D_RANGE_10_NOT_CONTRACT' END")
    return f"{out} AS (SELECT scode, trade_date, place, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS tokens FROM (SELECT *, {', '.join(columns)} FROM {view}))"


FEATURES_SQL = f"""{tokens_sql('bars', features.DAILY, 'dt')}, {tokens_sql('weeks', features.WEEKLY, 'wt')},
    met AS (SELECT a.scode, a.trade_date, a.tokens AS d, b.tokens AS w, b.place AS wp FROM dt a ASOF JOIN wt b ON a.scode = b.scode AND a.trade_date >= b.trade_date WHERE a.place >= 56),
    feats AS (SELECT scode, trade_date, list_sort(list_concat(d, w)) AS tokens FROM met WHERE wp >= 56 AND trade_date BETWEEN DATE '{START}' AND DATE '{END}')"""


def packed(spark, d):
    """What featured() has, with tokens still as integers."""
    b = daily(spark, d)
    return features.packed(b, bars.resample(b, "W", TODAY)).where(F.col("trade_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")))


def featured(spark, d):
    return patterns.with_tokens(packed(spark, d))


@query(f"WITH {BARS_SQL}, {WEEKLY_SQL}, {FEATURES_SQL} SELECT scode, trade_date, array_to_string(tokens, ' ') AS tokens FROM feats")
def pattern_features(spark, d):
    return featured(spark, d).withColumn("tokens", F.array_join("tokens", " "))


EVENTS_SQL = "events AS (SELECT scode, selection_date AS trade_date FROM surges)"
PAIRS_SQL = """hits AS (SELECT f.*, e.scode IS NOT NULL AS hit FROM feats f LEFT JOIN (SELECT DISTINCT * FROM ev) e ON e.scode = f.scode AND e.trade_date = f.trade_date),
    one AS (SELECT scode, trade_date, hit, unnest(tokens) AS t FROM hits),
    combos AS (SELECT t AS pattern, hit, scode, trade_date FROM one UNION ALL SELECT a.t || ' && ' || b.t, a.hit, a.scode, a.trade_date FROM one a JOIN one b ON a.scode = b.scode AND a.trade_date = b.trade_date AND a.t < b.t),
    counted AS (SELECT pattern, count(*) AS sample_count, count(CASE WHEN hit THEN 1 END) AS success_count FROM combos GROUP BY 1)"""
EV_SQL = "ev AS (SELECT scode, selection_date AS trade_date FROM surges)"
PATTERNS_SQL = f"WITH {BARS_SQL}, {WEEKLY_SQL}, {SURGE_SQL}, {EV_SQL}, {FEATURES_SQL}, {PAIRS_SQL}"


def surge_keys(spark, d):
    return labels.surge_events(daily(spark, d), START, END).select("scode", F.col("selection_date").alias("trade_date"))


def mined(spark, d, support: int, thresholds: tuple[float, ...], samples: int) -> DataFrame:
    return patterns.mined(packed(spark, d), surge_keys(spark, d), features.vocabulary(), 2, support, thresholds, samples)


@query(f"{PATTERNS_SQL} SELECT pattern, success_count AS positive_support FROM counted WHERE success_count > 0")
def pattern_support_1_2(spark, d):
    return patterns.support(surge_keys(spark, d), featured(spark, d), 2)


@query(f"{PATTERNS_SQL} SELECT pattern, sample_count, success_count, round(success_count / sample_count, 6) AS success_rate FROM counted WHERE success_count >= 50 AND sample_count >= 100")
def pattern_evaluation(spark, d):
    return rounded(mined(spark, d, 50, (0.0,), 100), "success_rate").select("pattern", "sample_count", "success_count", "success_rate")


@query(f"""{PATTERNS_SQL} SELECT pattern, t AS min_success_rate, sample_count, success_count FROM counted, (VALUES (0.1), (0.2), (0.3)) v(t)
    WHERE success_count >= 20 AND sample_count >= 50 AND success_count / sample_count >= CAST(t AS DOUBLE)""".replace("t AS min_success_rate", "CAST(t AS DOUBLE) AS min_success_rate"))
def pattern_thresholds(spark, d):
    return mined(spark, d, 20, (0.1, 0.2, 0.3), 50).select("pattern", "min_success_rate", "sample_count", "success_count")


@query(f"""WITH {BARS_SQL}, {WEEKLY_SQL}, {SURGE_SQL}, {EV_SQL}, {FEATURES_SQL}, hits AS (SELECT f.*, e.scode IS NOT NULL AS hit FROM feats f LEFT JOIN (SELECT DISTINCT * FROM ev) e ON e.scode = f.scode AND e.trade_date = f.trade_date)
    SELECT array_to_string(tokens, ' && ') AS signature, count(*) AS sample_count, count(CASE WHEN hit THEN 1 END) AS success_count, round(count(CASE WHEN hit THEN 1 END) / count(*), 6) AS success_rate FROM hits GROUP BY 1""")
def signature_support(spark, d):
    return rounded(patterns.signatures(featured(spark, d), surge_keys(spark, d)), "success_rate")


@query(f"""{PATTERNS_SQL}, good AS (SELECT pattern, round(success_count / sample_count, 6) AS score FROM counted WHERE success_count >= 50 AND sample_count >= 100)
    SELECT scode, trade_date, max(ROW(score, pattern))[1] AS score, max(ROW(score, pattern))[2] AS pattern, count(*) AS pattern_count FROM combos JOIN good USING (pattern) GROUP BY 1, 2""")
def best_pattern_per_stock(spark, d):
    good = mined(spark, d, 50, (0.0,), 100)
    return patterns.best_pattern_per_stock(packed(spark, d), rounded(good, "success_rate"), features.vocabulary())

"""Registered queries, continued: scans, scalars of dates, prices and texts, encodings, parsers, orders, searches, selections for training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions import scalars as S
from tidebar.operators import bars, datasets, encodings, features, labels, metrics, news, patterns, portfolio, scans, signals
from tidebar.sources import derived, raw
from tidebar.sources.derived import BARS_SQL, CONCEPTS, NEWS_SQL, STOCKS_SQL, TODAY

from .more_queries import CONCEPT_SQL, SCORED, THREE_SQL, rank_sql, scored
from .queries import END, EV_SQL, FEATURES_SQL, MA_SQL, PERFORMANCE_SQL, SIGNALS_SQL, START, SURGE_SQL, W, WEEKLY_SQL, daily, featured, query, rounded, surge_keys, weekly

# scans


@query(f"WITH {BARS_SQL}, {WEEKLY_SQL} SELECT scode, trade_date, round(close, 6) AS close FROM weeks WHERE trade_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'")
def weekly_range_scan(spark, d):
    return rounded(scans.between(weekly(spark, d), "2000-05-20", "2000-06-30", before=140).select("scode", "trade_date", "close"), "close")


@query(f"WITH {BARS_SQL} SELECT DISTINCT scode FROM bars")
def symbol_list(spark, d):
    return scans.symbols(daily(spark, d))


@query(f"WITH {BARS_SQL} SELECT scode, strftime(trade_date, '%Y%m%d') AS day, round(coalesce(close, 0), 6) AS close, round(coalesce(amount, 0), 4) AS amount FROM bars")
def zero_filled_bars(spark, d):
    return rounded(rounded(scans.zero_filled(daily(spark, d)).select("scode", "day", "close", "amount"), "close"), "amount", digits=4)


@query(f"WITH {NEWS_SQL} SELECT news_link FROM news WHERE CAST(publish_time AS DATE) BETWEEN DATE '2001-01-07' AND DATE '2001-01-23'")
def news_window_scan(spark, d):
    return scans.news_window(derived.news(spark, d), "2001-01-10", "2001-01-20", 3).select("news_link")


@query(f"WITH {BARS_SQL}, {SURGE_SQL} SELECT scode, coalesce(CASE WHEN day(selection_date) % 3 <> 0 THEN selection_date END, prev_trade_date) AS trade_date, round(gain_rate, 6) AS gain_rate FROM surges WHERE coalesce(CASE WHEN day(selection_date) % 3 <> 0 THEN selection_date END, prev_trade_date) BETWEEN DATE '1999-03-01' AND DATE '2000-09-30'")
def positive_event_scan(spark, d):
    events = labels.surge_events(daily(spark, d), START, END)
    gaps = events.withColumn("selection_date", F.when(F.day("selection_date") % 3 != 0, F.col("selection_date")))
    return rounded(scans.positive_events(gaps, "1999-03-01", "2000-09-30"), "gain_rate")


PARTS_SQL = "parts AS (SELECT p_type AS pattern, p_size / 50.0::DOUBLE AS success_rate, p_partkey % 17 AS success_count, p_partkey AS sample_count, DATE '2000-01-01' + CAST(p_partkey % 2 AS INTEGER) AS start_date FROM part)"


@query(f"WITH {PARTS_SQL} SELECT pattern, round(success_rate, 6) AS success_rate, success_count, sample_count FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY success_rate DESC, success_count DESC, sample_count DESC) AS n FROM parts WHERE success_rate >= 0.5 AND start_date = DATE '2000-01-01') WHERE n = 1")
def stored_pattern_scan(spark, d):
    key = F.col("p_partkey")
    stored = derived.table(spark, d, "part").select(F.col("p_type").alias("pattern"), (F.col("p_size") / 50.0).alias("success_rate"), (key % 17).alias("success_count"), key.alias("sample_count"), F.date_add(F.lit("2000-01-01").cast("date"), (key % 2).cast("int")).alias("start_date"))
    return rounded(scans.stored_patterns(stored, 0.5, "2000-01-01").select("pattern", "success_rate", "success_count", "sample_count"), "success_rate")


@query(f"WITH {BARS_SQL}, {STOCKS_SQL}, {SIGNALS_SQL} SELECT b.trade_date, b.scode, sname, round(close, 6) AS close, round(score, 6) AS score, 'ma_bullish distance=' || printf('%.2f', score * 100) || '%' AS reason, 'ma_bullish_v1' AS strategy_name FROM bullish b LEFT JOIN stocks s ON s.scode = b.scode ORDER BY b.score DESC, amount DESC, b.scode LIMIT 100")
def selection_contract(spark, d):
    return rounded(signals.selection(signals.ma_bullish(daily(spark, d)), derived.stocks(spark, d), 100), "close", "score")


@query(f"""WITH {BARS_SQL}, {SIGNALS_SQL}, {PERFORMANCE_SQL}, both_ AS (SELECT trade_date, scode, score, 'ma_bullish_v1' AS strategy_name FROM bullish UNION ALL SELECT trade_date, scode, performance, 'performance' FROM perf WHERE performance > 0.2),
    n AS (SELECT *, row_number() OVER (PARTITION BY strategy_name, trade_date ORDER BY score DESC, scode) AS n FROM both_) SELECT trade_date, scode, round(score, 6) AS score, strategy_name FROM n WHERE n <= 2""")
def merged_streams(spark, d):
    b = daily(spark, d)
    other = signals.performance_score(b).where("performance > 0.2").select("trade_date", "scode", F.lit(0.0).alias("close"), F.col("performance").alias("score"), F.lit("").alias("reason"), F.lit("performance").alias("strategy_name"))
    return rounded(signals.merged([signals.ma_bullish(b), other], 2).select("trade_date", "scode", "score", "strategy_name"), "score")


@query(f"WITH {BARS_SQL}, n AS (SELECT scode, trade_date AS signal_date, lead(trade_date) OVER ({W}) AS buy_date, lead(close) OVER ({W}) AS buy_close FROM bars) SELECT scode, signal_date, buy_date, round(buy_close, 6) AS buy_close FROM n WHERE day(signal_date) = 15")
def strict_next_bar(spark, d):
    b = daily(spark, d)
    rows = b.select("scode", "trade_date", F.col("trade_date").alias("buy_date"), F.col("close").alias("buy_close"))
    out = bars.asof_forward(b.where("day(trade_date) = 15").select("scode", "trade_date"), rows, ["buy_date", "buy_close"], strict=True)
    return rounded(out.withColumnRenamed("trade_date", "signal_date"), "buy_close")


@query(f"WITH {BARS_SQL}, a AS (SELECT DISTINCT scode, CAST(date_trunc('month', trade_date) AS DATE) + 14 AS asked FROM bars) SELECT a.scode, asked, trade_date AS found FROM a ASOF LEFT JOIN bars b ON a.scode = b.scode AND a.asked <= b.trade_date")
def entry_at_or_after(spark, d):
    b = daily(spark, d)
    asked = b.select("scode", F.date_add(F.trunc("trade_date", "month"), 14).alias("trade_date")).distinct()
    rows = b.select("scode", "trade_date", F.col("trade_date").alias("found"))
    return bars.asof_forward(asked, rows, ["found"]).withColumnRenamed("trade_date", "asked")


# scalars


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, greatest(strftime(o_orderdate, '%Y%m%d'), '19960101') AS bounded FROM orders""")
def date_scalars(spark, d):
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = F.when(key == 3, F.concat(F.lit("x"), F.date_format(day, "yyyyMMdd"))).when(key == 1, F.concat(F.lit(" "), F.date_format(day, "yyyyMMdd"), F.lit(" "))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return derived.table(spark, d, "orders").select("o_orderkey", S.lenient_date(text).alias("parsed"), S.bounded_start(F.date_format(day, "yyyyMMdd"), "19960101").alias("bounded"))


PRICE_SQL = """CASE WHEN ok1 AND (NOT ok2 OR abs(p1 - close) <= abs(p2 - close)) THEN p1 WHEN ok2 THEN p2 ELSE (high + low + close) / 3 END"""
PRICED_SQL = f"""priced AS (SELECT *, ROUND(CAST(CAST({PRICE_SQL} AS VARCHAR) AS DECIMAL(38, 10)), 2)::DOUBLE AS price FROM (
    SELECT *, coalesce(p1 >= 0.8 * low AND p1 <= 1.2 * high, false) AS ok1, coalesce(p2 >= 0.8 * low AND p2 <= 1.2 * high, false) AS ok2 FROM (SELECT *, amount * 100 / volume AS p1, amount * 10000 / volume AS p2 FROM bars)))"""


@query(f"WITH {BARS_SQL}, {PRICED_SQL} SELECT scode, trade_date, price, CAST(round_even(100000 / price / 100, 0) * 100 AS BIGINT) AS shares FROM priced")
def price_scalars(spark, d):
    rows = daily(spark, d).withColumn("price", S.bar_price())
    return rows.select("scode", "trade_date", "price", S.lot_shares(100_000.0, F.col("price")).alias("shares"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 20 > 1 THEN l_quantity / 2000 ELSE l_quantity / 20 END AS share, greatest(0.0, least(1.0, 1 - l_quantity / 40)) AS failure,
    CASE WHEN l_linenumber <= 7 THEN (5 + l_linenumber) / 200.0::DOUBLE END AS loss FROM lineitem""")
def rate_scalars(spark, d):
    q = F.col("l_quantity")
    step = F.when(F.col("l_linenumber") % 2 == 1, ((5 + F.col("l_linenumber")) / 2).cast("int").cast("string")).otherwise(F.concat(((5 + F.col("l_linenumber")) / 2).cast("int").cast("string"), F.lit(".5")))
    name = F.concat(F.lit("stop_loss_"), step, F.lit("pct_take_profit_10_20_hold_3d"))
    return derived.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.percent_or_share(q / 20).alias("share"), S.failure_rate(q / 40).alias("failure"), F.round(S.rule_loss(name), 6).alias("loss"))


def ratio_sql(value: str, over: str) -> str:
    return rf"CASE WHEN {over} > 0 THEN regexp_replace(printf('%.2f', coalesce({value}, 0.0) / {over}), '\.?0+$', '') ELSE '0' END"


@query(f"SELECT l_orderkey, l_linenumber, {ratio_sql('l_extendedprice', '(l_quantity * 997 - 500)')} AS ratio, coalesce(list_avg(list_filter([l_discount, l_tax, l_discount - l_tax], lambda x: x > 0)), 0) AS mean FROM lineitem")
def ratio_scalars(spark, d):
    rows = derived.table(spark, d, "lineitem")
    mean = S.positive_average(F.array("l_discount", "l_tax", F.col("l_discount") - F.col("l_tax")))
    return rows.select("l_orderkey", "l_linenumber", S.ratio_text(F.col("l_extendedprice"), F.col("l_quantity") * 997 - 500).alias("ratio"), mean.alias("mean"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS said FROM pages""")
def clean_texts(spark, d):
    return derived.table(spark, d, "pages").select("page_id", S.clean_text(F.col("html")).alias("said"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN date_trunc('day', o_orderdate) ELSE date_trunc('day', o_orderdate) + to_hours(9) + to_minutes(30) END AS published FROM orders""")
def publish_times(spark, d):
    t, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.date_format(t, "EEE, d MMM yyyy"), F.lit(" 09:30:00 GMT"))).when(k == 1, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T09:30:00"))).when(k == 2, F.concat(F.date_format(t, "yyyy/MM/dd"), F.lit(" 09:30:00"))).when(k == 3, F.date_format(t, "yyyy-MM-dd")).otherwise("soon")
    return derived.table(spark, d, "orders").select("o_orderkey", S.publish_time(text).alias("published"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE CAST(1 + c_custkey % 3 AS BIGINT) END AS n FROM customer")
def json_lists(spark, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit('["'), "c_name", F.lit('"]'))).when(k == 1, F.concat(F.lit('["'), "c_name", F.lit('", "b"]'))).otherwise("{broken")
    return derived.table(spark, d, "customer").select("c_custkey", F.size(S.json_strings(text)).cast("long").alias("n"))


# texts of windows


def line_sql(columns: tuple[str, ...]) -> str:
    """Lines of a window w (a list of bars, oldest first) as compact text."""
    def mean(c: str) -> str:
        return f"coalesce(list_avg(list_filter(list_transform(w, lambda b: b.{c}), lambda x: x > 0)), 0)"

    cells = [ratio_sql(f"b.{c}", f"m_{c if c in ('volume', 'amount') else 'close'}") for c in columns]
    means = ", ".join(f"{mean(c)} AS m_{c}" for c in ("close", "volume", "amount"))
    return means, f"array_to_string(list_transform(w, lambda b, i: concat_ws(',', CAST(i AS VARCHAR), {', '.join(cells)})), chr(10))"


def windows_sql(view: str, size: int) -> str:
    """For each bar of a view the list of its last `size` bars, oldest first, or null."""
    fields = "{" + ", ".join(f"'{c}': coalesce({c}, 0.0)" for c in datasets.COLUMNS) + "}"
    frame = f"OVER ({W} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"(SELECT scode, trade_date, CASE WHEN count(*) {frame} = {size} THEN list({fields}) {frame} END AS w FROM {view})"


_means, _text = line_sql(("close", "volume"))


@query(f"""WITH {BARS_SQL}, full_ AS (SELECT *, {MA_SQL} FROM bars) SELECT scode, trade_date, {_text} AS lines FROM (SELECT *, {_means} FROM {windows_sql('full_', 5)} WHERE w IS NOT NULL) WHERE day(trade_date) = 15""")
def compact_lines(spark, d):
    b = bars.moving_averages(daily(spark, d))
    found = datasets.window_arrays(b.where("day(trade_date) = 15").select("scode", "trade_date"), b, 5).where("bars IS NOT NULL")
    return found.select("scode", "trade_date", datasets.compact_text(F.col("bars"), ("close", "volume")).alias("lines"))


def sample_sql(mode: str) -> str:
    """Samples of positives as the user's text."""
    means, text = line_sql(datasets.COLUMNS)
    parts, joins = [f"'s=' || e.scode", f"'mode={mode}'", f"'cols=i,{','.join(datasets.COLUMNS)}'"], ""
    for name, view, size in zip("DWM", ("days_", "weeks_", "months_"), datasets.MODES[mode]):
        if size:
            joins += f" ASOF JOIN (SELECT scode, trade_date, {text} AS t, w IS NOT NULL AS whole FROM (SELECT *, {means} FROM {windows_sql(view, size)})) {name} ON {name}.scode = e.scode AND {name}.trade_date <= e.trade_date"
            parts += [f"'{name}'", f"{name}.t"]
    whole = " AND ".join(f"{n}.whole" for n, size in zip("DWM", datasets.MODES[mode]) if size)
    return f"SELECT e.scode, e.trade_date, concat_ws(chr(10), {', '.join(parts)}) AS content FROM ev e{joins} WHERE {whole}"


MONTHLY_SQL = f"""monthly AS (SELECT scode, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open, arg_max(close, trade_date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume, coalesce(sum(amount), 0) AS amount
    FROM bars WHERE date_trunc('month', trade_date) < date_trunc('month', DATE '{TODAY}') GROUP BY scode, date_trunc('month', trade_date))"""


@query(f"""WITH {BARS_SQL}, {WEEKLY_SQL}, {MONTHLY_SQL}, {THREE_SQL}, days_ AS (SELECT *, {MA_SQL} FROM bars), weeks_ AS (SELECT *, {MA_SQL} FROM weeks), months_ AS (SELECT *, {MA_SQL} FROM monthly),
    ev AS (SELECT scode, trade_date FROM three WHERE label = 'positive') {sample_sql('long')}""")
def sample_messages(spark, d):
    b = daily(spark, d)
    averaged = [bars.moving_averages(x) for x in (b, bars.resample(b, "W", TODAY), bars.resample(b, "M", TODAY))]
    events = labels.threeclass_labels(b).where("label = 'positive'").select("scode", "trade_date", "label")
    return datasets.samples(events, *averaged, "long").select("scode", "trade_date", F.col("messages")[0]["content"].alias("content"))


@query(f"""WITH {BARS_SQL}, w AS (SELECT scode, trade_date, CASE WHEN count(*) OVER f = 5 THEN list({{'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume}}) OVER f END AS w FROM bars WINDOW f AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT scode, trade_date, array_to_string(list_transform(w, lambda b: concat_ws(' ', CAST(round((b.open / last_ - 1) * 10000) AS BIGINT), CAST(round((b.high / last_ - 1) * 10000) AS BIGINT), CAST(round((b.low / last_ - 1) * 10000) AS BIGINT), CAST(round((b.close / last_ - 1) * 10000) AS BIGINT), CAST(round(b.volume / mean_ * 100) AS BIGINT))), ',') AS points
    FROM (SELECT *, w[5].close AS last_, list_avg(list_transform(w, lambda b: b.volume)) AS mean_ FROM w WHERE w IS NOT NULL AND day(trade_date) = 15)""".replace("round(", "round_even(").replace("10000)", "10000, 0)").replace("* 100)", "* 100, 0)"))
def basis_point_rows(spark, d):
    b = daily(spark, d)
    found = datasets.window_arrays(b.where("day(trade_date) = 15").select("scode", "trade_date"), b, 5, ("open", "high", "low", "close", "volume")).where("bars IS NOT NULL")
    rows = encodings.basis_points(F.col("bars"))
    return found.select("scode", "trade_date", F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), " ")), ",").alias("points"))


@query(f"""WITH {BARS_SQL}, w AS (SELECT scode, trade_date, CASE WHEN count(*) OVER f = 3 THEN list({{'day': strftime(trade_date, '%Y-%m-%d'), 'close': close, 'volume': volume}}) OVER f END AS w FROM bars WINDOW f AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT scode, trade_date, w[1].day AS first_day, true AS close_kept, w[3].day AS last_day, w[3].volume AS last_volume FROM w WHERE w IS NOT NULL AND day(trade_date) = 15""")
def payload_round_trip(spark, d):
    """Windows as JSON records, read back: prices to four decimals."""
    b = daily(spark, d)
    found = datasets.window_arrays(b.where("day(trade_date) = 15").select("scode", "trade_date"), b, 3, ("close", "volume")).where("bars IS NOT NULL")
    back = found.withColumn("r", F.from_json(encodings.payload(F.col("bars"), ("close", "volume")), "array<struct<date:string,close:double,volume:double>>"))
    kept = F.abs(F.col("r")[0]["close"] - F.col("bars")[0]["close"]) < 5.1e-5
    return back.select("scode", "trade_date", F.col("r")[0]["date"].alias("first_day"), kept.alias("close_kept"), F.col("r")[2]["date"].alias("last_day"), F.col("r")[2]["volume"].alias("last_volume"))


@query(f"""{SCORED} SELECT scode, trade_date, '{{"c":"' || label || '"}}' AS text, '{{"p":' || y || '}}' AS number, label AS c, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS p FROM scored""")
def answer_texts(spark, d):
    s = scored(spark, d).select("scode", "trade_date", encodings.answer(F.col("actual")).alias("text"), encodings.answer(F.col("label"), "number").alias("number"))
    return s.select("*", encodings.answered(F.concat(F.lit("It is "), "text", F.lit("."))).alias("c"), encodings.answered(F.col("number")).alias("p"))


# parsers


@query("""SELECT lpad(right(CAST(p_partkey AS VARCHAR), 6), 6, '0') AS scode, make_date(2000 + p_size % 10, 12, 31) AS report_date, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS bonus, CASE WHEN p_partkey % 3 = 0 THEN 2.5::DOUBLE END AS transfer,
    CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 2.5::DOUBLE ELSE 0 END END AS bonus_total, CASE WHEN p_partkey % 5 = 0 THEN 1.7::DOUBLE ELSE 0.3 END AS cash, make_date(2001, 6, 20) AS ex_date FROM part""")
def distribution_plan_rows(spark, d):
    k = F.col("p_partkey")
    parts = [F.when(k % 2 == 0, F.concat(F.lit("10送"), F.col("p_size").cast("string"), F.lit("股"))), F.when(k % 3 == 0, "10转2.5股"), F.when(k % 5 == 0, "10派1.7元")]
    records = derived.table(spark, d, "part").select(F.concat(F.lit("sz"), k.cast("string")).alias("security_code"), (2000 + F.col("p_size") % 10).cast("string").alias("nd"), F.lit("0.3").alias("fh_sh"), F.lit(None).cast("string").alias("djr"), F.lit("2001-06-20").alias("cqr"), F.concat_ws(", ", *parts).alias("FHcontent"))
    return raw.distribution_plans(records).select("scode", "report_date", "bonus", "transfer", "bonus_total", "cash", "ex_date")


@query(f"WITH {BARS_SQL} SELECT '000001' AS scode, trade_date, round(open, 4) AS open, round(close, 4) AS close, CAST(volume AS DOUBLE) AS volume, CASE WHEN day(trade_date) % 2 = 0 THEN 12.5 END AS amount FROM bars WHERE scode = '000001'")
def vendor_bar_rows(spark, d):
    b = rounded(daily(spark, d).where("scode = '000001'"), "open", "close", digits=4)
    cells = F.concat(F.lit('["'), F.col("trade_date").cast("string"), F.lit('","'), F.col("open").cast("string"), F.lit('","'), F.col("close").cast("string"), F.lit('","0","0","'), F.col("volume").cast("string"), F.lit('"'),
                     F.when(F.day("trade_date") % 2 == 0, F.lit(',{},"x","12.5"')).otherwise(F.lit("")), F.lit("]"))
    payloads = b.select(F.concat(F.lit('k_1 = {"data":{"000001":{"day":['), cells, F.lit(',["short"]]}}}')).alias("payload"))
    return raw.vendor_bars(payloads, "000001").select("scode", "trade_date", "open", "close", "volume", "amount")


@query("""SELECT trim(regexp_replace('T ' || doc_id || ' & more', '\\s+', ' ', 'g')) AS title, 'http://x/' || doc_id AS news_link, 'bold ' || source AS summary, 'Mon, 05 Jan 2026 10:00:00 GMT' AS publish_time FROM documents WHERE doc_id % 3 <> 0""")
def feed_item_rows(spark, d):
    link = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("<link> http://x/"), F.col("doc_id").cast("string"), F.lit("</link>"))).otherwise("")
    item = F.concat(F.lit("<item><title>T  "), F.col("doc_id").cast("string"), F.lit(" &amp; more</title>"), link, F.lit("<description><![CDATA[<b>bold</b> "), "source", F.lit("]]></description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>"))
    feeds = derived.table(spark, d, "documents").select(F.concat(F.lit("<?xml version='1.0'?><rss>"), item, F.lit("<item><title>none</title></item></rss>")).alias("xml"))
    return raw.feed_items(feeds)


@query(f"""WITH {NEWS_SQL}, n AS (SELECT news_link, title, heat, source_name, CAST(publish_time AS VARCHAR) AS t FROM news WHERE doc_id % 4 <> 0 UNION ALL SELECT news_link, 'again ' || title, heat + 1, source_name, CAST(publish_time AS VARCHAR) FROM news WHERE doc_id % 8 = 1)
    SELECT news_link, heat FROM (SELECT *, row_number() OVER (PARTITION BY news_link ORDER BY t DESC, heat DESC) AS k FROM n) WHERE k = 1 ORDER BY t DESC, heat DESC, news_link LIMIT 100""")
def crawled_news(spark, d):
    rows = derived.news(spark, d).withColumn("t", F.col("publish_time").cast("string"))
    first = rows.select(F.when(F.col("doc_id") % 4 != 0, F.col("news_link")).otherwise(" ").alias("a"), F.col("title").alias("b"), F.col("t").alias("c"), F.col("heat").alias("h"))
    again = rows.where("doc_id % 8 = 1").select(F.col("news_link").alias("a"), F.concat(F.lit("again "), "title").alias("b"), F.col("t").alias("c"), (F.col("heat") + 1).alias("h"))
    columns = {"news_link": "a", "title": "b", "publish_time": "c", "heat": "h"}
    return news.crawl([news.news_rows(x, "other", columns) for x in (first, again)], 100).select("news_link", "heat")


@query(f"""WITH {NEWS_SQL}, {CONCEPT_SQL}, heats AS (SELECT concept, count(*) / (SELECT count(*) FROM news) AS h FROM (SELECT unnest(concepts) AS concept FROM concepts) GROUP BY 1) SELECT concept, round(h, 6) AS heat FROM heats""")
def merged_concept_heat(spark, d):
    stored = news.with_concept_heat(news.with_concepts(derived.news(spark, d), CONCEPTS))
    return rounded(news.merged_heat(stored), "heat")


PIECES_SQL = """pieces AS (SELECT page_id, url, unnest(string_split(html, '<a ')[2:]) AS p, generate_subscripts(string_split(html, '<a ')[2:], 1) AS place FROM pages),
    hrefs AS (SELECT page_id, place, regexp_extract(p, '^[^>]*?href="([^"]*)"', 1) AS href, replace(trim(regexp_replace(regexp_extract(p, '^[^>]*>(.*?)</a>', 1), '\\s+', ' ', 'g')), '&amp;', '&') AS title, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host FROM pieces),
    links AS (SELECT page_id, host || replace(href, '&amp;', '&') AS link, arg_min(title, place) AS title, min(place) AS place FROM hrefs WHERE length(title) >= 8 AND NOT contains(href, '#') AND starts_with(href, '/') GROUP BY 1, 2)"""


@query(f"WITH {PIECES_SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n, title, link FROM links")
def html_links(spark, d):
    return raw.page_links(derived.table(spark, d, "pages")).select("page_id", F.col("n").cast("long").alias("n"), "title", "link")


# searches and selections


HALVES_SQL = """train AS (SELECT DISTINCT * FROM ev WHERE trade_date < DATE '2000-01-01'), held AS (SELECT DISTINCT * FROM ev WHERE trade_date >= DATE '2000-01-01'),
    one AS (SELECT f.scode, f.trade_date, t.scode IS NOT NULL AS a, h.scode IS NOT NULL AS b, unnest(tokens) AS pattern, array_to_string(tokens[1:6], ' && ') AS signature FROM feats f LEFT JOIN train t ON t.scode = f.scode AND t.trade_date = f.trade_date LEFT JOIN held h ON h.scode = f.scode AND h.trade_date = f.trade_date)"""
SEARCH_SQL = f"WITH {BARS_SQL}, {WEEKLY_SQL}, {SURGE_SQL}, {EV_SQL}, {FEATURES_SQL}, {HALVES_SQL}"


@query(f"""{SEARCH_SQL}, c AS (SELECT pattern, count(*) AS n, count(*) FILTER (a) AS sa, count(*) FILTER (b) AS sb FROM one GROUP BY 1), good AS (SELECT *, CASE WHEN sa >= 20 THEN 20 WHEN sa >= 5 THEN 5 WHEN sa >= 1 THEN 1 END AS least FROM c WHERE sa / n >= 0.002 AND sb / n >= 0.002 AND sa >= 1)
    SELECT pattern, sa AS positive_support, n AS sample_count, sb AS success_count FROM good WHERE sa >= (SELECT max(least) FROM good)""")
def goal_pattern_search(spark, d):
    e = surge_keys(spark, d)
    found = patterns.goal_search(featured(spark, d), e.where("trade_date < DATE '2000-01-01'"), e.where("trade_date >= DATE '2000-01-01'"), (1,), (20, 5, 1), 0.002)
    return found.select("pattern", "positive_support", "sample_count", "success_count")


@query(f"""{SEARCH_SQL}, c AS (SELECT signature, count(*) AS n, count(*) FILTER (a) AS sa, count(*) FILTER (b) AS sb FROM (SELECT DISTINCT scode, trade_date, a, b, signature FROM one) GROUP BY 1), good AS (SELECT *, CASE WHEN sa >= 3 THEN 3 WHEN sa >= 1 THEN 1 END AS least FROM c WHERE sa / n >= 0.01 AND sb / n >= 0.01 AND sa >= 1)
    SELECT signature, sa AS positive_support, n AS sample_count, sb AS success_count FROM good WHERE sa >= (SELECT max(least) FROM good)""")
def signature_pattern_search(spark, d):
    e = surge_keys(spark, d)
    short = featured(spark, d).withColumn("tokens", F.slice("tokens", 1, 6))  # whole token sets hardly ever come again
    found = patterns.signature_search(short, e.where("trade_date < DATE '2000-01-01'"), e.where("trade_date >= DATE '2000-01-01'"), (3, 1), 0.01)
    return found.select("signature", "positive_support", "sample_count", "success_count")


@query(f"""WITH {BARS_SQL}, {WEEKLY_SQL}, {FEATURES_SQL}, t AS (SELECT unnest(tokens) AS token FROM feats) SELECT token, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS rate FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 10""")
def most_common_tokens(spark, d):
    rows = featured(spark, d).select(F.explode("tokens").alias("token"))
    return rounded(patterns.most_common(rows, "token", 10), "rate")


@query(f"""WITH {BARS_SQL}, {WEEKLY_SQL}, {FEATURES_SQL} SELECT scode, trade_date, CAST(len(tokens) AS BIGINT) AS n, list_contains(tokens, 'D_CLOSE_GT_MA5') AND list_contains(tokens, 'W_CLOSE_GT_MA5') AS both_ FROM feats""")
def pattern_matches(spark, d):
    pattern = patterns.parse_pattern(F.lit("W_CLOSE_GT_MA5 && D_CLOSE_GT_MA5 && "))
    return featured(spark, d).select("scode", "trade_date", F.size("tokens").cast("long").alias("n"), patterns.matches(pattern, F.col("tokens")).alias("both_"))


@query(f"""{SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, scode, trade_date) AS n, count(*) OVER () AS c FROM scored WHERE y = 1), e AS (SELECT max(c) AS c, CAST(ceil(max(c) * 0.3::DOUBLE) AS BIGINT) AS edge, greatest(least(max(c), 1), CAST(ceil(ceil(max(c) * 0.3::DOUBLE) * 0.1::DOUBLE) AS BIGINT)) AS kept FROM n),
    top_ AS (SELECT scode, trade_date, y, row_number() OVER (ORDER BY {rank_sql(7, "'top'", 'scode', 'trade_date')}, scode, trade_date) AS k FROM n, e WHERE n <= edge),
    zeros AS (SELECT scode, trade_date, y, row_number() OVER (ORDER BY {rank_sql(7, "'top'", 'scode', 'trade_date')}, scode, trade_date) AS k FROM scored WHERE y = 0)
    SELECT scode, trade_date, y AS label FROM top_, e WHERE k <= kept UNION ALL SELECT scode, trade_date, y FROM n, e WHERE n > edge UNION ALL SELECT scode, trade_date, y FROM zeros, e WHERE k <= (e.c - edge + kept) * 4""")
def positive_reshuffle(spark, d):
    return datasets.positive_reshuffle(scored(spark, d).select("scode", "trade_date", "label", "score")).select("scode", "trade_date", "label")


@query(f"""{SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, scode, trade_date) AS n FROM scored WHERE y = 0 AND label = 'negative'),
    f AS (SELECT scode, trade_date, row_number() OVER (ORDER BY {rank_sql(7, "'refill'", 'scode', 'trade_date')}, scode, trade_date) AS n FROM k WHERE n > 40 AND score <= 0.98)
    SELECT scode, trade_date FROM k WHERE n <= 40 UNION ALL SELECT scode, trade_date FROM f WHERE n <= 60""")
def reshuffle_split(spark, d):
    """Hard negatives: the 40 best scored stay, the rest up to 100 is drawn again by hash."""
    s = scored(spark, d).where("label = 0 AND actual = 'negative'").withColumn("kind", F.col("actual"))
    return datasets.reshuffle(s, s, s.where("score > 0.98"), {"negative": 40}, {"negative": 100}).select("scode", "trade_date")


@query(f"""{SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY score) AS k FROM scored) SELECT scode, trade_date, CASE WHEN k <= 2 AND y = 1 THEN 0.5::DOUBLE ELSE 1.0 END AS weight FROM r""")
def decayed_weights(spark, d):
    rows = scored(spark, d).withColumn("weight", F.lit(1.0))
    return metrics.decayed_weights(rows, ["trade_date"], 2, 0.5).select("scode", "trade_date", "weight")


@query(f"""{SCORED}, r AS (SELECT trade_date, y, rank() OVER (PARTITION BY trade_date ORDER BY score DESC) AS u, rank() OVER (PARTITION BY trade_date ORDER BY score) AS l FROM scored), g AS (SELECT trade_date, min(u) AS u, min(l) AS l FROM r WHERE y = 1 GROUP BY 1)
    SELECT count(*) AS groups, count(*) FILTER (u = 1) AS top1, count(*) FILTER (l = 1) AS bottom1 FROM g""")
def group_extremes(spark, d):
    return metrics.group_extremes(scored(spark, d), ["trade_date"])


@query(f"""{SCORED}, c AS (SELECT k AS class, count(*) FILTER (label = k AND predicted = k) AS tp, count(*) FILTER (label = k) AS a, count(*) FILTER (predicted = k) AS p FROM scored, (VALUES ('positive'), ('negative'), ('neutral')) v(k) GROUP BY 1),
    f AS (SELECT avg(CASE WHEN tp > 0 THEN 2.0 * tp / (a + p) ELSE 0 END) AS m FROM c), q AS (SELECT count(*) FILTER (label = predicted) / count(*) AS accuracy FROM scored) SELECT round(accuracy, 6) AS accuracy, round(m, 6) AS macro_f1, accuracy >= 0.5 AND m >= 0.99 AS passed FROM q, f""")
def overall_gate(spark, d):
    return rounded(metrics.gate(metrics.overall_report(scored(spark, d)), {"accuracy": 0.5, "macro_f1": 0.99}), "accuracy", "macro_f1")


LABELLED = f"""WITH {BARS_SQL}, {THREE_SQL}, k AS (SELECT scode, trade_date, CASE label WHEN 'negative' THEN 'down6' ELSE label END AS label FROM three WHERE label IN ('negative', 'neutral')),
    ranked AS (SELECT *, {rank_sql(7, "'balance'", 'scode', 'trade_date')} AS h FROM k)"""


@query(f"""{LABELLED}, c AS (SELECT least(count(*) FILTER (label = 'down6'), count(*) FILTER (label = 'neutral') // 3) AS kept FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, scode, trade_date) AS n FROM ranked)
    SELECT scode, trade_date, label, row_number() OVER (ORDER BY h, scode, trade_date) AS rank_no FROM n, c WHERE n <= kept * CASE label WHEN 'down6' THEN 1 ELSE 3 END""")
def balanced_down6(spark, d):
    rows = labels.threeclass_labels(daily(spark, d)).where("label IN ('negative', 'neutral')").select("scode", "trade_date", F.when(F.col("label") == "negative", "down6").otherwise("neutral").alias("label"))
    return datasets.balanced_rows(rows, 3).select("scode", "trade_date", "label", F.col("rank_no").cast("long").alias("rank_no"))


@query(f"""{LABELLED}, u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, scode, trade_date) AS n FROM ranked WHERE day(trade_date) % 3 <> 0) SELECT scode, trade_date, label FROM u WHERE n <= CASE label WHEN 'down6' THEN 20 ELSE 50 END""")
def until_target(spark, d):
    """Ranked events until each class has its target; every third day has no sample."""
    rows = labels.threeclass_labels(daily(spark, d)).where("label IN ('negative', 'neutral')").select("scode", "trade_date", F.when(F.col("label") == "negative", "down6").otherwise("neutral").alias("label"))
    ranked = rows.withColumn("hash_rank", S.stable_rank(7, F.lit("balance"), F.col("scode"), F.col("trade_date")))
    return datasets.until_target(ranked, rows.where("day(trade_date) % 3 <> 0").select("scode", "trade_date"), {"down6": 20, "neutral": 50}).select("scode", "trade_date", "label")


@query(f"""{SCORED}, f AS (SELECT scode, trade_date, {rank_sql(7, "'pool'", 'scode', 'trade_date')} AS h FROM scored WHERE score <= 0.9) SELECT scode, trade_date FROM f ORDER BY h, scode, trade_date LIMIT 100""")
def replacement_pool(spark, d):
    s = scored(spark, d).select("scode", "trade_date", "score")
    return datasets.replacement_pool(s, s.where("score > 0.9"), 100).select("scode", "trade_date")


@query(f"""{SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY scode, trade_date) - 1 AS n, count(*) OVER () AS c FROM scored) SELECT scode, trade_date FROM n WHERE n % greatest(1, c // 50) = 0 AND n // greatest(1, c // 50) < 50""")
def stride_subset(spark, d):
    return datasets.eval_subset(scored(spark, d), "stride", 50, ["scode", "trade_date"]).select("scode", "trade_date")


@query(f"""WITH {BARS_SQL}, {THREE_SQL}, ev AS (SELECT scode, trade_date, label FROM three WHERE label = 'positive') SELECT 'long' AS mode, CAST(1 AS BIGINT) AS modes, min(CAST(trade_date AS VARCHAR)) AS first_anchor, max(CAST(trade_date AS VARCHAR)) AS last_anchor, count(*) AS samples, count(DISTINCT label) AS labels FROM ev""")
def dataset_settings(spark, d):
    rows = labels.threeclass_labels(daily(spark, d)).where("label = 'positive'")
    meta = F.struct("scode", F.col("trade_date").cast("string").alias("anchor_date"), "label", F.lit("long").alias("sample_mode"))
    return datasets.dataset_settings(rows.select(meta.alias("metadata")))


@query(f"""WITH {BARS_SQL}, w AS (SELECT scode, trade_date, close, min(low) OVER f AS lo, max(high) OVER f AS hi FROM bars WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT scode, trade_date, CASE WHEN hi <= lo THEN close <= lo ELSE close <= lo + (hi - lo) * 0.1 END AS low_band FROM w""")
def bottom_band(spark, d):
    w = bars.along().rowsBetween(-19, 0)
    rows = daily(spark, d).withColumns({"lo": F.min("low").over(w), "hi": F.max("high").over(w)})
    return rows.select("scode", "trade_date", datasets.in_bottom_band(F.col("close"), F.col("lo"), F.col("hi")).alias("low_band"))


@query(f"WITH {BARS_SQL} SELECT scode, trade_date FROM bars WHERE trade_date = DATE '2000-06-15' AND fmod(close * 37 + volume, 1.0) >= 0.1 ORDER BY fmod(close * 37 + volume, 1.0) DESC, scode LIMIT 20")
def predicted_day(spark, d):
    """The best 20 by a deterministic scorer that gets batches of rows."""
    rows = daily(spark, d).where("trade_date = DATE '2000-06-15'").select("scode", "trade_date", "close", "volume")
    return metrics.predict_day(rows, lambda frame: (frame["close"] * 37 + frame["volume"]) % 1.0, 0.1, 20).select("scode", "trade_date")


@query(f"{SCORED}, t AS (SELECT CAST(hash_ AS VARCHAR) AS t FROM (SELECT scode || ':' || CAST(trade_date AS VARCHAR) AS hash_ FROM scored)) SELECT count(DISTINCT t) AS n FROM t")
def candidate_fingerprint(spark, d):
    rows = scored(spark, d).select(F.concat_ws(":", "scode", F.col("trade_date").cast("string")).alias("t"))
    return scans.set_fingerprint(rows.union(rows), "t").select("n")


# portfolio


SCHEDULE_SQL = f"""{PRICED_SQL}, nexts AS (SELECT scode, trade_date AS selection_date, lead(trade_date) OVER ({W}) AS buy_date, lead(price) OVER ({W}) AS price, lead(trade_date, 2) OVER ({W}) AS path_1 FROM priced)"""


@query(f"WITH {BARS_SQL}, {SIGNALS_SQL}, {SCHEDULE_SQL} SELECT b.scode, selection_date, buy_date, price, CAST(round_even(100000 / price / 100, 0) * 100 AS BIGINT) AS shares, path_1 FROM bullish b JOIN nexts n ON n.scode = b.scode AND n.selection_date = b.trade_date WHERE buy_date IS NOT NULL AND price > 0")
def portfolio_schedule(spark, d):
    b = daily(spark, d)
    found = portfolio.schedule(signals.ma_bullish(b).select("scode", "trade_date"), b)
    return found.select("scode", "selection_date", "buy_date", "price", "shares", F.get("path", F.lit(0))["trade_date"].alias("path_1"))


@query(f"""WITH RECURSIVE {BARS_SQL}, {STOCKS_SQL}, {SIGNALS_SQL}, days AS MATERIALIZED (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM bars)),
    c AS MATERIALIZED (SELECT i, list(b.scode ORDER BY score DESC, b.scode) AS codes FROM bullish b JOIN stocks s ON s.scode = b.scode JOIN days USING (trade_date) WHERE NOT (contains(upper(replace(sname, ' ', '')), 'ST') OR contains(upper(replace(sname, ' ', '')), 'PT')) GROUP BY 1),
    walk AS (SELECT CAST(-1 AS BIGINT) AS i, CAST([] AS STRUCT(s VARCHAR, i BIGINT)[]) AS rest
        UNION ALL SELECT w.i + 1, list_concat(list_filter(rest, lambda x: w.i + 1 - x.i <= 13), list_transform(list_filter(coalesce(codes, []), lambda s: NOT list_contains(list_transform(list_filter(rest, lambda x: w.i + 1 - x.i <= 13), lambda x: x.s), s))[1:3], lambda s: {{'s': s, 'i': w.i + 1}}))
        FROM walk w LEFT JOIN c ON c.i = w.i + 1 WHERE w.i + 1 < (SELECT count(*) FROM days))
    SELECT d.trade_date, x.s AS scode FROM (SELECT i, unnest(rest) AS x FROM walk) r JOIN days d ON d.i = r.i WHERE x.i = r.i""")
def selection_filter_with_limit(spark, d):
    b = daily(spark, d)
    found = signals.ma_bullish(b).join(derived.stocks(spark, d).select("scode", "sname"), "scode")
    return portfolio.selected(found, bars.calendar(b), limit=3).select("trade_date", "scode")


@query(f"""WITH {BARS_SQL}, {SIGNALS_SQL}, {PRICED_SQL}, p AS (SELECT scode, trade_date AS selection_date, lead(trade_date) OVER w AS buy_date, lead(price) OVER w AS price,
        lead(open, 2) OVER w AS o1, lead(low, 2) OVER w AS l1, lead(close, 2) OVER w AS c1, lead(high, 2) OVER w AS h1 FROM priced WINDOW w AS ({W})),
    s AS (SELECT p.*, ROUND(CAST(CAST(price * 0.94 AS VARCHAR) AS DECIMAL(38, 10)), 2)::DOUBLE AS at_ FROM p JOIN bullish b ON b.scode = p.scode AND b.trade_date = p.selection_date WHERE price > 0)
    SELECT scode, selection_date, buy_date, price, CASE WHEN o1 <= at_ THEN 'gap_open_stop_loss_6pct' WHEN l1 <= at_ THEN 'stop_loss_6pct' END AS stopped FROM s WHERE buy_date IS NOT NULL""")
def first_day_stops(spark, d):
    """Whether each scheduled signal is stopped out on the first bar after it was bought, under the rule of 6 percent."""
    b = daily(spark, d)
    planned = portfolio.positions(portfolio.schedule(signals.ma_bullish(b).select("scode", "trade_date"), b), [0.06])
    first, sale = F.get(F.col("marks"), F.lit(1))["day"], F.get(F.col("sales"), F.lit(0))
    stopped = F.when((sale["day"] == first) & F.contains(sale["reason"], F.lit("stop_loss")), sale["reason"])
    return planned.select("scode", "selection_date", "buy_date", "price", stopped.alias("stopped"))


@query(f"WITH {BARS_SQL}, {WEEKLY_SQL}, {SIGNALS_SQL} SELECT trade_date, scode, 'ma_bullish_v1' AS strategy_name FROM bullish")
def strategy_run(spark, d):
    b = daily(spark, d)
    return signals.run_strategy(signals.MA_BULLISH, b, bars.resample(b, "W", TODAY)).select("trade_date", "scode", "strategy_name")


TABLE_SQL = "p AS (SELECT p_type || ' ' || p_partkey AS pattern, CASE p_size % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0.3 END::DOUBLE AS min_success_rate, p_size / 50.0::DOUBLE AS success_rate, p_partkey % 7 AS success_count, p_partkey % 11 AS sample_count FROM part)"


@query(f"WITH {TABLE_SQL} SELECT pattern FROM p ORDER BY min_success_rate, success_rate DESC, success_count DESC, sample_count DESC, pattern LIMIT 40")
def pattern_order(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rate = F.when(size % 3 == 0, 0.1).when(size % 3 == 1, 0.2).otherwise(0.3)
    rows = derived.table(spark, d, "part").select(F.concat_ws(" ", "p_type", k.cast("string")).alias("pattern"), rate.alias("min_success_rate"), (size / 50.0).alias("success_rate"), (k % 7).alias("success_count"), (k % 11).alias("sample_count"))
    return patterns.ordered(rows).limit(40).select("pattern")


@query(f"{SCORED}, m AS (SELECT s.*, close, CAST(floor(score * 10) AS DOUBLE) AS sc, CAST(floor(down * 5) AS BIGINT) AS pc FROM scored s JOIN bars USING (scode, trade_date)) SELECT scode, trade_date FROM m ORDER BY sc DESC, pc DESC, close DESC, scode, trade_date LIMIT 50")
def pattern_selection_order(spark, d):
    found = scored(spark, d).select("scode", "trade_date", F.floor(F.col("score") * 10).cast("double").alias("score"), F.floor(F.col("down") * 5).alias("pattern_count"))
    return patterns.selection_order(found, daily(spark, d), 50).select("scode", "trade_date")


@query(f"{SCORED} SELECT trade_date, array_to_string(list_transform(list(ROW(score, scode) ORDER BY score DESC, scode)[1:5], lambda x: x[2]), ', ') AS best FROM scored GROUP BY 1")
def top_texts(spark, d):
    """The five best of each day as one text of codes."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "scode", F.lit(0.5).alias("probability"))))
    rows = scored(spark, d).groupBy("trade_date").agg(encodings.top_text(ordered).alias("t"))
    return rows.select("trade_date", F.replace("t", F.lit(":0.5"), F.lit("")).alias("best"))


@query("""SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A && B' ELSE 'B && C' || (p_size % 4) END AS pattern FROM part WHERE p_partkey % 5 <> 0""")
def proposed_patterns(spark, d):
    """Patterns out of texts that a model could have given: JSON in prose, tokens in any order, unknown ones."""
    k = F.col("p_partkey")
    own = F.when(k % 3 == 0, '["A", "A"]').when(k % 3 == 1, '["B", "A"]').otherwise(F.concat(F.lit('["C'), (F.col("p_size") % 4).cast("string"), F.lit('", "B"]')))
    text = F.when(k % 5 != 0, F.concat(F.lit('Here: {"patterns": ['), own, F.lit(', ["X"], []]} as asked'))).otherwise("nothing {broken")
    known = spark.createDataFrame([(t,) for t in ("A", "B", "C0", "C1", "C2", "C3")], "token string")
    return patterns.proposed(derived.table(spark, d, "part").select(text.alias("response")), known)


@query("""WITH c AS (SELECT l_linestatus AS pattern, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus || ' && ' || l_returnflag, count(*) FROM lineitem WHERE l_returnflag < 'R' GROUP BY 1 UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1)
    SELECT s.pattern || ' && ' || r.pattern AS pattern, coalesce(b.n, least(s.n, r.n)) AS positive_support FROM c s, c r LEFT JOIN c b ON b.pattern = s.pattern || ' && ' || r.pattern WHERE s.pattern IN ('F', 'O') AND r.pattern IN ('A', 'N', 'R')""")
def estimated_supports(spark, d):
    rows = derived.table(spark, d, "lineitem").select("l_linestatus", "l_returnflag")
    counts = [rows.groupBy(F.col("l_linestatus").alias("pattern")), rows.groupBy(F.col("l_returnflag").alias("pattern")), rows.where("l_returnflag < 'R'").groupBy(F.concat_ws(" && ", "l_linestatus", "l_returnflag").alias("pattern"))]
    one, two, both = (c.agg(F.count("*").alias("positive_support")) for c in counts)
    wanted = spark.createDataFrame([(f"{m} && {f}",) for m in "FO" for f in "ANR"], "pattern string")
    return patterns.estimated_support(wanted, one.union(two).union(both))


@query(f"""WITH {BARS_SQL}, c AS (SELECT DISTINCT scode, trade_date, close FROM bars WHERE CAST(scode AS INTEGER) % 5 = 2 AND day(trade_date) = 15) SELECT scode, trade_date, round(close + 1, 6) AS close FROM c
    UNION ALL SELECT scode, trade_date, round(close, 6) FROM bars b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.scode = b.scode)""")
def rebuilt_history(spark, d):
    """Symbols with corrected bars keep those alone."""
    from tidebar.streaming import ingest

    b = daily(spark, d).select("scode", "trade_date", "close")
    corrected = b.where("cast(scode AS int) % 5 = 2 AND day(trade_date) = 15").withColumn("close", F.col("close") + 1)
    return rounded(ingest.rebuilt(b, corrected), "close")


@query("""SELECT p_partkey, '2001-01-02' AS first_day, p_size * 1.0::DOUBLE AS close, CAST(p_size % 3 AS BIGINT) AS weeks FROM part""")
def old_payloads(spark, d):
    """Windows out of payloads of the old form."""
    size = F.col("p_size")
    weeks = F.concat_ws(",", F.array_repeat(F.lit('{"date":"2001-01-05","close":1}'), (size % 3).cast("int")))
    text = F.concat(F.lit('{"scode":"1","daily_55":[{"date":"2001-01-02","close":'), size.cast("string"), F.lit('}],"weekly_55":['), weeks, F.lit("]}"))
    rows = derived.table(spark, d, "part").select("p_partkey", encodings.old_windows(text).alias("w"))
    return rows.select("p_partkey", F.col("w.daily_55")[0]["date"].alias("first_day"), F.col("w.daily_55")[0]["close"].alias("close"), F.size("w.weekly_55").cast("long").alias("weeks"))


@query(f"{SCORED}, h AS (SELECT scode, trade_date, {rank_sql(7, 'scode', 'trade_date')} AS r FROM scored) (SELECT scode, trade_date, 'fixed' AS kind FROM scored ORDER BY scode, trade_date LIMIT 30) UNION ALL (SELECT scode, trade_date, 'random' FROM h ORDER BY r, scode, trade_date LIMIT 30)")
def evaluation_subsets(spark, d):
    s, key = scored(spark, d).select("scode", "trade_date"), ["scode", "trade_date"]
    parts = [datasets.eval_subset(s, kind, 30, key).select(*key, F.lit(kind).alias("kind")) for kind in ("fixed", "random")]
    return parts[0].union(parts[1])


@query(f"""WITH {BARS_SQL}, full_ AS (SELECT *, {MA_SQL} FROM bars), w AS (SELECT scode, trade_date, list(coalesce(ma13, 0)) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM full_) SELECT scode, trade_date, len(m) = 8 AND len(list_filter(m[-5:], lambda x: x > 0)) = 5 AS valid FROM w WHERE day(trade_date) = 15""")
def valid_samples(spark, d):
    """Windows of the mode `short`, days in the place of weeks too."""
    b = bars.moving_averages(daily(spark, d))
    found = datasets.window_arrays(b.where("day(trade_date) = 15").select("scode", "trade_date"), b, 8)
    return found.select("scode", "trade_date", F.coalesce(datasets.valid_windows(F.col("bars"), F.col("bars"), F.array(), "short"), F.lit(False)).alias("valid"))


@query(f"{SCORED} SELECT scode, trade_date, label FROM scored WHERE label IN ('positive', 'negative')")
def labelled_union(spark, d):
    """Positive and negative events as one stream."""
    rows = scored(spark, d).select("scode", "trade_date", F.col("actual").alias("label"))
    return rows.where("label = 'positive'").unionByName(rows.where("label = 'negative'"))


@query("""SELECT c_custkey, CASE WHEN contains(c_name, '7') THEN 1.0 ELSE 0.0 END + 0.0 AS base, least(1.0, CASE WHEN contains(c_name, '7') THEN 1.0 ELSE 0.0 END + 0.15 * (CASE WHEN contains(c_name, '1') THEN 1 ELSE 0 END + CASE WHEN contains(c_name, '2') THEN 1 ELSE 0 END))::DOUBLE AS score FROM customer""".replace("CASE WHEN contains(c_name, '7') THEN 1.0 ELSE 0.0 END + 0.0 AS base, ", ""))
def match_scores(spark, d):
    return derived.table(spark, d, "customer").select("c_custkey", news.match_score(F.lit("7"), F.col("c_name"), F.array(F.lit("1"), F.lit("2"))).alias("score"))

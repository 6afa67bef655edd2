"""Small cases of the bar operators, with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.functions import scalars as S
from tidebar.operators import backtest, bars, datasets, features, labels, metrics, news, patterns, portfolio, signals
from tidebar.sources import raw, store

DAY = dt.date(2026, 1, 1)


def bar_rows(closes, scode="000001", step=1, volumes=None, spread=0.1, opens=None):
    return [(scode, DAY + dt.timedelta(days=i * step), float((opens or closes)[i]), float(c), float(c + spread), float(c - spread), float(volumes[i] if volumes else 10000), 1000.0) for i, c in enumerate(closes)]


BARS = "scode string, trade_date date, open double, close double, high double, low double, volume double, amount double"


def test_rising_series_is_selected(spark):
    closes = [10 + 0.1 * i for i in range(60)]
    df = spark.createDataFrame(bar_rows(closes, opens=[c - 0.05 for c in closes]), BARS)
    days = [r.trade_date for r in signals.ma_bullish(df).collect()]
    assert DAY + dt.timedelta(days=59) in days and min(days) == DAY + dt.timedelta(days=54)


def test_weekly_volume_drop(spark):
    closes = [12.0, 12.2, 12.1, 12.3, 12.4, 12.0, 11.0, 10.0]
    drop = spark.createDataFrame(bar_rows(closes, step=7, volumes=[1000, 1100, 1000, 1200, 1000, 3000, 3200, 1000]), BARS)
    found = signals.weekly_volume_drop(drop).collect()
    assert len(found) == 1 and "weekly_volume_drop" in found[0].reason
    flat = spark.createDataFrame(bar_rows(closes, step=7, volumes=[1000] * 8), BARS)
    assert signals.weekly_volume_drop(flat).count() == 0


def test_forward_outcomes(spark):
    def run(lows, amount=10211.0):
        rows = [("000001", DAY + dt.timedelta(days=i), 10.0, 10.0, 13.0, float(low), 100.0, amount if i >= 3 else 1000.0) for i, low in enumerate(lows)]
        signal = spark.createDataFrame([("000001", DAY, 10.0)], "scode string, trade_date date, close double")
        return backtest.evaluate(signal, spark.createDataFrame(rows, BARS)).collect()

    good = run([10.0] * 3 + [10.3] * 7)[0]
    assert good.success and not good.explosive and good.rise_rate == pytest.approx(0.03)
    assert run([10.0] * 3 + [12.1] * 7)[0].explosive
    assert run([10.0] * 8) == []


def test_weekly_and_monthly_bars(spark):
    rows = spark.createDataFrame([("1", d, 1.0, 2.0, 3.0, 0.5, 1.0, None) for d in (dt.date(2026, 4, 30), dt.date(2026, 5, 8), dt.date(2026, 5, 11))], BARS)
    weeks = [r.trade_date for r in bars.resample(rows, "W", "2026-05-12").orderBy("trade_date").collect()]
    assert weeks == [dt.date(2026, 5, 1), dt.date(2026, 5, 8)]
    months = bars.resample(rows, "M", "2026-05-12").collect()
    assert [(r.trade_date, r.amount) for r in months] == [(dt.date(2026, 4, 30), 0.0)]


def test_surge_event(spark):
    rows = spark.createDataFrame(bar_rows([9.8, 10.0, 10.5, 11.0, 12.1, 12.8]), BARS)
    found = labels.surge_events(rows, "2026-01-03", "2026-01-03").collect()
    assert [(r.start_rise_date.day, r.prev_trade_date.day, r.selection_date.day) for r in found] == [(3, 2, 1)]
    assert found[0].gain_rate == pytest.approx(12.8 / 10.5 - 1)
    assert labels.surge_events(spark.createDataFrame(bar_rows([10, 11, 12, 13]), BARS), "2026-01-01", "2026-01-31").count() == 0


@pytest.mark.parametrize("ahead,label", [([(10.5, 9.7), (12.1, 9.5), (10, 9)], "positive"), ([(10.5, 9.3), (12.5, 9.8), (10, 9.8)], "negative"), ([(10.5, 9.5), (11, 9.6), (11.9, 9.5)], "neutral"), ([(12.1, 9.3), (10, 10), (10, 10)], "discard")])
def test_three_classes(spark, ahead, label):
    rows = [("1", DAY, 10.0, 10.0, 10.0, 10.0, 1.0, 1.0)] + [("1", DAY + dt.timedelta(days=i + 1), 10.0, 10.0, float(h), float(lo), 1.0, 1.0) for i, (h, lo) in enumerate(ahead)]
    assert labels.threeclass_labels(spark.createDataFrame(rows, BARS)).collect()[0].label == label


def test_cooldown(spark):
    events = spark.createDataFrame([("000001", i) for i in (1, 10, 22)] + [("000002", 10)], "scode string, trade_index int")
    assert sorted(map(tuple, datasets.cooldown(events, 20).collect())) == [("000001", 1), ("000001", 22), ("000002", 10)]


def test_asof_takes_the_last_week_at_or_before(spark):
    left = spark.createDataFrame([("1", dt.date(2025, 12, 31))], "scode string, trade_date date")
    right = spark.createDataFrame([("1", dt.date(2025, 12, d), d) for d in (19, 26)] + [("1", dt.date(2026, 1, 2), 2)], "scode string, trade_date date, v int")
    assert bars.asof_backward(left, right, ["v"]).collect()[0].v == 26
    assert bars.asof_forward(left, right, ["v"]).collect()[0].v == 2


def test_combinations(spark):
    df = spark.createDataFrame([(["A", "B", "C"],)], "t array<string>").select(patterns.combinations(F.col("t"), 2).alias("c"), patterns.combinations(F.col("t"), 3).alias("d"))
    row = df.first()
    assert row.c == [["A"], ["B"], ["C"], ["A", "B"], ["A", "C"], ["B", "C"]] and row.d[-1] == ["A", "B", "C"]


def test_short_windows_have_no_tokens(spark):
    rows = bars.moving_averages(spark.createDataFrame(bar_rows([10.0] * 20), BARS))
    assert features.tokens(rows, features.DAILY).where("tokens IS NOT NULL").count() == 0


def test_ratio_texts_and_plans(spark):
    df = spark.createDataFrame([("10送6股, 10转2股, 10派1.7元", "1.5万", "2,300")], "p string, a string, b string")
    row = df.select(S.number_before(F.col("p"), "送").alias("s"), S.number_before(F.col("p"), "转").alias("z"), S.number_before(F.col("p"), "派").alias("c"), S.parse_heat(F.col("a")).alias("a"), S.parse_heat(F.col("b")).alias("b"), S.parse_heat(F.lit("")).alias("e"),
                    S.ratio_text(F.lit(1.5), F.lit(1.0)).alias("r"), S.ratio_text(F.lit(2.0), F.lit(2.0)).alias("one"), S.ratio_text(F.lit(1.0), F.lit(0.0)).alias("zero"), S.round_cent(F.lit(2.675)).alias("cent")).first()
    assert tuple(row) == (6.0, 2.0, 1.7, 15000, 2300, 0, "1.5", "1", "0", 2.68)


def test_compact_text(spark):
    rows = spark.createDataFrame([([(1, 2.0, 100.0, 1000.0), (2, 2.0, 200.0, 3000.0)],)], "bars array<struct<place:int,close:double,volume:double,amount:double>>")
    assert rows.select(datasets.compact_text(F.col("bars"), ("close", "volume", "amount"))).first()[0] == "1,1,0.67,0.5\n2,1,1.33,1.5"


def test_distribution_plan(spark):
    rows = spark.createDataFrame([("sz000001", "2012", None, "2013-06-19", "2013-06-20", "10送6股, 10派1.7元")], "security_code string, nd string, fh_sh string, djr string, cqr string, FHcontent string")
    r = raw.distribution_plans(rows).first()
    assert (r.scode, str(r.report_date), r.bonus, r.transfer, r.bonus_total, r.cash) == ("000001", "2012-12-31", 6.0, None, 6.0, 1.7)


def test_vendor_bars(spark):
    text = 'kline={"data":{"s1":{"qfqday":[["2026-05-08","11.34","11.30","11.42","11.30","798820.00",{},"0.41","90573.78",""],["x"]]}}}'
    found = raw.vendor_bars(spark.createDataFrame([(text,)], "payload string"), "s1").collect()
    assert [(r.open, r.close, r.amount) for r in found] == [(11.34, 11.30, 90573.78)]


def test_csv_bars(spark, tmp_path):
    (tmp_path / "600000.csv").write_text("日期,开盘,收盘,最高,最低,成交量\n2026-01-02,1,2,3,0.5,100\n2026/01/03,1,x,3,0.5,100\n")
    found = raw.csv_bars(spark, str(tmp_path)).orderBy("trade_date").collect()
    assert [(r.scode, r.trade_date.day, r.close) for r in found] == [("600000", 2, 2.0), ("600000", 3, None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.csv").write_text("date,open\n2026-01-02,1\n")
    with pytest.raises(ValueError, match="missing"):
        raw.csv_bars(spark, str(tmp_path / "bad"))


def test_concepts_and_heat(spark):
    rows = spark.createDataFrame([("AI 芯片", "银行"), ("AI", "")], "title string, summary string")
    found = news.with_concepts(rows)
    assert [r.concepts for r in found.orderBy(F.desc("title")).collect()] == [["AI", "半导体", "银行"], ["AI"]]
    assert {r.concept: r.heat for r in news.concept_heat(found).collect()}["AI"] == 1.0


def test_feed_and_links(spark):
    xml = "<rss><item><title>A &amp; B</title><link>http://x/1</link><description><![CDATA[<b>text</b>]]></description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>no link</title></item></rss>"
    r = raw.feed_items(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(x.title, x.news_link, x.summary) for x in r] == [("A & B", "http://x/1", "text")]
    html = '<a href="/n/1">a title that is long</a><a href="javascript:x">a title that is long</a><a href="/2">short</a><a href="/n/1">a title that is long</a>'
    links = raw.page_links(spark.createDataFrame([(1, "http://h/p", html)], "page_id long, url string, html string")).collect()
    assert [(x.n, x.link) for x in links] == [(1, "http://h/n/1")]


def portfolio_run(spark, bar, loss=0.03):
    d1, d2, d3 = (DAY + dt.timedelta(days=i) for i in (0, 1, 2))
    rows = [("000001", d1, 10.0, 10.0, 10.0, 10.0, 10000.0, 1000.0), ("000001", d2, 10.0, 10.0, 10.0, 10.0, 10000.0, 1000.0), ("000001", d3, *map(float, bar), 10000.0, 1000.0)]
    signal = spark.createDataFrame([("000001", d1, 1.0)], "scode string, trade_date date, score double")
    found = portfolio.schedule(signal, spark.createDataFrame(rows, BARS))
    days = spark.createDataFrame([(d,) for d in (d1, d2, d3)], "trade_date date")
    return portfolio.trades(portfolio.simulate(found, days, str(d3), [loss])).where("side = 'SELL'").orderBy("price").collect()


@pytest.mark.parametrize("bar,loss,reason,price", [
    ((10, 10, 12, 9.4), 0.03, "intraday_stop_loss_5pct", 9.5), ((9.3, 9.4, 9.5, 9.2), 0.03, "gap_open_stop_loss_5pct", 9.3), ((10, 9.6, 10.1, 9.6), 0.03, "close_stop_loss_3pct", 9.6),
    ((10, 10, 12, 9.5), 0.05, "stop_loss_5pct", 9.5), ((9.0, 9.2, 9.4, 8.8), 0.06, "gap_open_stop_loss_6pct", 9.0), ((10, 10, 11.5, 10), 0.03, "take_profit_10pct_half", 11.0)])
def test_exits(spark, bar, loss, reason, price):
    sold = portfolio_run(spark, bar, loss)
    assert (sold[0].reason, sold[0].price) == (reason, price)
    assert sold[0].shares == (5000 if "half" in reason else 10000)


def test_cash_is_conserved(spark):
    d = [DAY + dt.timedelta(days=i) for i in range(6)]
    rows = [(f"{s:06d}", x, 10.0, 10.0 + 0.1 * s, 10.5 + 0.3 * s, 9.9, 10000.0, 1000.0) for s in range(5) for x in d]
    signals_ = spark.createDataFrame([(f"{s:06d}", d[0], 1.0) for s in range(5)], "scode string, trade_date date, score double")
    days = spark.createDataFrame([(x,) for x in d], "trade_date date")
    held = portfolio.simulate(portfolio.schedule(signals_, spark.createDataFrame(rows, BARS)), days, str(d[-1]), [0.03])
    trades = portfolio.trades(held).collect()
    assert sum(t.side == "BUY" for t in trades if t.trade_date == d[1]) == 3
    cash = 1_000_000.0 + sum((t.gross - t.fee) if t.side == "SELL" else -(t.gross + t.fee) for t in trades)
    assert portfolio.daily(held, days).orderBy(F.desc("trade_date")).first().cash == pytest.approx(cash)


def test_selection_filter(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i), i) for i in range(15)], "trade_date date, day_index int")
    rows = [("s", DAY + dt.timedelta(days=i), "000001", "good", 0.9) for i in range(15)] + [("s", DAY, "000002", "*ST bad", 1.0)]
    found = spark.createDataFrame(rows, "strategy_name string, trade_date date, scode string, sname string, score double")
    for limit in (None, 2):
        assert sorted(r.trade_date.day for r in portfolio.selected(found, days, 13, limit).collect()) == [1, 15]


def test_precision_and_split(spark):
    rows = spark.createDataFrame([(str(i), i % 2, i / 10) for i in range(10)], "k string, label int, score double")
    at = {r.k: r.precision for r in metrics.precision_at(rows, ["k"], (5, 20)).collect()}
    assert at == {5: 0.6, 20: 0.5}
    split = datasets.hash_split(rows, 1, ["k"])
    assert split.where("is_eval").count() == 2 and datasets.hash_split(rows.limit(1), 1, ["k"]).where("is_eval").count() == 0


def test_hard_negative_refill(spark):
    rows = spark.createDataFrame([(str(i), DAY, "a", float(i)) for i in range(20)], "scode string, trade_date date, kind string, score double")
    out = datasets.reshuffle(rows, rows, rows.where("score < 5"), {"a": 3}, {"a": 10})
    keys = [int(r.scode) for r in out.collect()]
    assert len(keys) == len(set(keys)) == 10 and {17, 18, 19} <= set(keys) and min(keys) >= 5
    with pytest.raises(ValueError):
        datasets.reshuffle(rows, rows, rows, {"a": 3}, {"a": 10})


def test_upsert_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), path, ["k"])
    for _ in range(2):
        store.upsert(spark.createDataFrame([(1, "b"), (None, "m"), (2, "c")], "k int, v string"), path, ["k"])
        assert sorted((r.v) for r in store.read_table(spark, path).collect()) == ["b", "c", "m"]


def test_fifo(spark):
    rows = [("1", 1, "BUY", 100, 10.0, 1.0), ("1", 2, "BUY", 100, 20.0, 1.0), ("1", 3, "SELL", 150, 30.0, 2.0)]
    df = spark.createDataFrame([(s, 0, o, side, n, p, fee, n * p) for s, o, side, n, p, fee in rows], "scode string, selection_date int, o int, side string, shares long, price double, fee double, gross double")
    r = portfolio.realized(df, ["o"]).first()
    assert (r.buy_cost, r.buy_fee, r.realized_pnl) == (2000.0, 1.5, 4500 - 2 - 2000 - 1.5)


def test_scorer(spark):
    rows = spark.createDataFrame([(f"{i}", float(i)) for i in range(10)], "scode string, x double")
    best = metrics.predict_day(rows, lambda f: f["x"] / 10, 0.5, 3).collect()
    assert [(r.scode, r.rank_no) for r in sorted(best, key=lambda r: r.rank_no)] == [("9", 1), ("8", 2), ("7", 3)]

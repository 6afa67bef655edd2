"""Operators against brute force: first in first out, places in an order, patterns in one pass, addresses, tables that survive a crash."""

import datetime as dt
import os
import random
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidebar.functions import scalars as S
from tidebar.operators import bars, datasets, features, metrics, patterns, portfolio, signals
from tidebar.sources import raw, store

DAY = dt.date(2026, 1, 1)


def brute_fifo(trades):
    """Share by share."""
    queue, out = [], {}
    for o, side, shares, price, fee in trades:
        if side == "BUY":
            queue += [(o, price, fee / shares)] * shares
    taken = 0
    for o, side, shares, price, fee in trades:
        if side == "SELL":
            used = queue[taken : taken + shares]
            taken += shares
            cost, fees = sum(p for _, p, _ in used), sum(f for _, _, f in used)
            out[o] = (cost, fees, shares * price - fee - cost - fees)
    return out


def test_fifo_share_by_share(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for key in range(12):
        trades = [(o, rng.choice(["BUY", "SELL"]), rng.randint(1, 9), rng.randint(5, 20) / 2, rng.randint(0, 4) / 8) for o in range(rng.randint(1, 30))]
        rows += [(str(key), 0, *t, t[2] * t[3]) for t in trades]
        want |= {(str(key), o): v for o, v in brute_fifo(trades).items()}
    df = spark.createDataFrame(rows, "scode string, selection_date int, o int, side string, shares long, price double, fee double, gross double")
    found = {(r.scode, r.o): (r.buy_cost, r.buy_fee, r.realized_pnl) for r in portfolio.realized(df, ["o"]).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    assert portfolio.realized(df.where("false"), ["o"]).count() == 0


def test_ordinals(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 5]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int")
    found = {r.b: r.n for r in bars.ordinals(df, F.col("a"), [F.col("a"), F.col("b")]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == {b: n for n, (_, b) in enumerate(order)}


def test_forward_asof(spark):
    rng = random.Random(3)
    left = [(str(rng.randint(0, 3)), DAY + dt.timedelta(days=rng.randint(0, 60)), i) for i in range(80)]
    right = list({(str(rng.randint(0, 2)), DAY + dt.timedelta(days=rng.randint(0, 60))) for _ in range(60)})
    a, b = spark.createDataFrame(left, "scode string, trade_date date, i int"), spark.createDataFrame([(*r, r[1]) for r in right], "scode string, trade_date date, found date")
    for strict in (False, True):
        found = {r.i: r.found for r in bars.asof_forward(a, b, ["found"], strict=strict).collect()}
        for s, day, i in left:
            later = [d for k, d in right if k == s and (d > day if strict else d >= day)]
            assert found[i] == (min(later) if later else None)


def test_patterns_in_one_pass(spark):
    rng = random.Random(4)
    tokens = [f"T{i}" for i in range(9)]
    rows = [(str(i), DAY, sorted(rng.sample(tokens, rng.randint(0, 5)))) for i in range(60)]
    f = spark.createDataFrame(rows, "scode string, trade_date date, tokens array<string>")
    e = spark.createDataFrame([(str(i), DAY) for i in range(0, 60, 3)], "scode string, trade_date date")
    for most in (1, 2, 3):
        two = patterns.evaluate(patterns.support(e, f, most).where("positive_support >= 2"), f, e, most, (0.2, 0.4), 3)
        one = patterns.mined(f, e, tokens, most, 2, (0.2, 0.4), 3)
        columns = ("pattern", "positive_support", "sample_count", "success_count", "success_rate", "min_success_rate", "feature_count")
        assert sorted(map(tuple, one.select(*columns).collect())) == sorted(map(tuple, two.select(*columns).collect()))
    good = patterns.mined(f, e, tokens, 2, 2)
    best = {r.scode: (r.score, r.pattern, r.pattern_count) for r in patterns.best_pattern_per_stock(f, good, tokens).collect()}
    rates = {r.pattern: r.success_rate for r in good.collect()}
    for s, _, own in rows:
        hits = [(rates[p], p) for p in [*own, *(f"{a} && {b}" for i, a in enumerate(own) for b in own[i + 1 :])] if p in rates]
        assert best.get(s) == ((*max(hits), len(hits)) if hits else None)
    assert patterns.parse_pattern(F.lit("b && a && ")) is not None
    assert spark.range(1).select(patterns.parse_pattern(F.lit("b && a && "))).first()[0] == ["a", "b"]
    assert len(features.vocabulary()) == len(set(features.vocabulary()))


def test_addresses(spark):
    bases = ["http://h.example/a/b/c?x=1", "https://h.example", "http://h.example/a/", "http://h.example:80/p"]
    hrefs = ["/n/1", "n/1", "../n", "./n/./m", "../../../n", "//other/x", "http://o/x?y", "?q=2", "a/../b/", "x/..", "/a/./b?c=/../d"]
    rows = [(b, h) for b in bases for h in hrefs]
    found = spark.createDataFrame(rows, "b string, h string").select("b", "h", S.joined_url(F.col("b"), F.col("h")).alias("u")).collect()
    for r in found:
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def test_links_with_fragments_and_long_titles(spark):
    html = f"<A class=x HREF='/1#top'>a title that is long</A><a name=x></a><a href='n?a=1&amp;b=2'>{'long ' * 200}</a><a href=\"/3\"><b>a &amp; b are</b> here</a>"
    links = raw.page_links(spark.createDataFrame([(1, "http://h/p/q", html), (2, None, None)], "page_id long, url string, html string")).orderBy("n").collect()
    assert [(r.n, r.link) for r in links] == [(1, "http://h/p/n?a=1&b=2"), (2, "http://h/3")]
    assert (len(links[0].title), len(links[0].summary), links[1].title) == (512, 999, "a & b are here")


def test_the_last_line_of_a_day_stays(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,date,open,close,high,low,vol\n1,2026-01-02,1,2,3,1,5\n1,2026-01-02,1,7,3,1,5\n1,2026-01-03,1,4,3,1,5\n")
    found = raw.csv_bars(spark, str(tmp_path)).orderBy("trade_date").collect()
    assert [(r.scode, r.close, r.ma5) for r in found] == [("000001", 7.0, None), ("000001", 4.0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, month string, v string")


def test_a_crash_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.upsert(frame(spark, [(1, "a", "x"), (2, "b", "y")]), path, ["k"])
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # after the data are written, before they are named
        store.upsert(frame(spark, [(1, "a", "new")]), path, ["k"])
    monkeypatch.undo()
    assert sorted(r.v for r in store.read_table(spark, path).collect()) == ["x", "y"]
    store.upsert(frame(spark, [(2, "b", "z"), (2, "b", "a"), (3, "a", "w")]), path, ["k"])
    assert sorted(r.v for r in store.read_table(spark, path).collect()) == ["w", "x", "z"]  # of rows that repeat a key one stays


def test_only_touched_parts_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    by = F.col("month")
    store.upsert(frame(spark, [(i, m, "old") for i, m in enumerate("aabbcc")]), path, ["k"], by)
    before = store._entry(spark, path, 1)
    store.upsert(frame(spark, [(2, "b", "new"), (9, "d/x", "new")]), path, ["k"], by)
    now = store._entry(spark, path, 2)
    assert {p for p in now if now[p] != before.get(p)} == {"b", "d_x"} and now["a"] == before["a"]
    assert sorted((r.k, r.v) for r in store.read_table(spark, path).collect()) == [(0, "old"), (1, "old"), (2, "new"), (3, "old"), (4, "old"), (5, "old"), (9, "new")]
    for i in range(3):
        store.upsert(frame(spark, [(2, "b", f"n{i}")]), path, ["k"], by)
    assert store._entries(spark, path) == [4, 5] and store.read_table(spark, path).count() == 7
    store.upsert(frame(spark, []), path, ["k"], by)
    assert store._entries(spark, path) == [4, 5]
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "none"))
    store.upsert(frame(spark, []), str(tmp_path / "empty"), ["k"])
    assert store.read_table(spark, str(tmp_path / "empty")).columns == ["k", "month", "v"]


def test_files(spark, tmp_path):
    rows = frame(spark, [(1, "a", "x"), (2, None, "y")]).coalesce(1)
    store.write_jsonl(rows, str(tmp_path / "j"))
    assert store.read_jsonl(spark, str(tmp_path / "j"), "k int, month string, v string", limit=1).count() == 1
    (tmp_path / "j2").mkdir()
    (tmp_path / "j2" / "x.json").write_text('{"k": 1}\n{broken\n')
    assert [r.line for r in store.broken_lines(spark, str(tmp_path / "j2"), "k int").collect()] == ["{broken"]
    for append in (False, True):
        store.write_csv(rows, str(tmp_path / "c"), bom=True, append=append)
    files = [f for f in os.listdir(tmp_path / "c") if f.endswith(".csv")]
    assert len(files) == 2 and all((tmp_path / "c" / f).read_bytes().startswith(b"\xef\xbb\xbfk,month,v") for f in files)
    listed = store.master_list([spark.createDataFrame([], "scode string, sname string"), spark.createDataFrame([("sz1", " b "), ("sh2", "a"), ("1", "c")], "scode string, sname string")])
    assert [(r.scode, r.sname) for r in listed.collect()] == [("000001", "b"), ("000002", "a")]
    with pytest.raises(ValueError):
        store.master_list([])


def test_pools_and_targets(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), DAY, float(i)) for i in range(50)], "scode string, trade_date date, score double")
    pool = datasets.replacement_pool(rows, rows.where("score < 40"), 10, path=str(tmp_path / "pool"))
    assert {int(r.scode) for r in pool.collect()} == set(range(40, 50))
    assert datasets.replacement_pool(rows.limit(0), rows, 10, path=str(tmp_path / "pool")).count() == 10  # found again
    with pytest.raises(ValueError):
        datasets.replacement_pool(rows, rows, 1)
    with pytest.raises(Exception, match="no bars"):
        bars.latest_day(rows.limit(0)).collect()
    report = spark.createDataFrame([(0.5, None)], "a double, b double")
    assert [metrics.gate(report, x).first().passed for x in ({"a": 0.5}, {"a": 0.6}, {"b": 0.0})] == [True, False, False]
    common = patterns.most_common(spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "t string"), "t", 2).collect()
    assert [tuple(r) for r in common] == [("b", 2, 0.5), ("a", 1, 0.25)]
    with pytest.raises(ValueError):
        S.rule_name(0.02)
    assert spark.range(1).select(S.two_decimals(F.lit(0.125)), S.two_decimals(F.lit(1.005)), S.two_decimals(F.lit(-1234.375))).first() == ("0.12", "1.00", "-1234.38")
    found = spark.createDataFrame([(DAY, "1", 1.0, 5.0, 2.0, "r", "s"), (DAY, "2", 1.0, 9.0, 2.0, "r", "s")], "trade_date date, scode string, close double, amount double, score double, reason string, strategy_name string")
    out = signals.selection(found, spark.createDataFrame([("2", "two")], "scode string, sname string")).collect()
    assert [(r.scode, r.sname) for r in out] == [("2", "two"), ("1", None)]


def cents(x):
    return float(Decimal(str(x)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def brute_run(scheduled, days, end, loss):
    """Day by day over dictionaries: what is traded, what is held, and the day's sums."""
    money, held, trades, holdings, sums = 1_000_000.0, [], [], [], []
    for day in days:
        if day > end and not held and not any(r.buy_date == day for r in scheduled):
            break
        bought = sold = fees = 0.0
        for p in held:
            at = [i for i, b in enumerate(p["path"]) if b.trade_date == day]
            if not at:
                continue
            bar, cost = p["path"][at[0]], p["price"]
            tests = [("open", 0.95, None, "gap_open_stop_loss_5pct"), ("low", 0.95, 0.95, "intraday_stop_loss_5pct"), ("close", 0.97, None, "close_stop_loss_3pct")] if loss == 0.03 else [
                ("open", 1 - loss, None, f"gap_open_stop_loss_{loss * 100:g}pct"), ("low", 1 - loss, 1 - loss, f"stop_loss_{loss * 100:g}pct")]
            sales = []
            for field, bound, price, reason in tests:
                if bar[field] <= cents(cost * bound):
                    sales = [(p["left"], cents(bar[field]) if price is None else cents(cost * price), reason)]
                    break
            else:
                left = p["left"]
                if left == p["shares"] and bar.high >= cents(cost * 1.1):
                    sales.append((min(left, max(1, left // 2)), cents(cost * 1.1), "take_profit_10pct_half"))
                    left -= sales[-1][0]
                if left and bar.high >= cents(cost * 1.2):
                    sales.append((left, cents(cost * 1.2), "take_profit_20pct_remaining"))
                    left = 0
                if left and at[0] == 2:
                    sales.append((left, cents(bar.close), "time_exit_day3_close"))
            for n, price, reason in sales:
                fee = cents(n * price * 0.0002) + cents(n * price * 0.0005)
                money += n * price - fee
                sold, fees = sold + n * price, fees + fee
                p["left"] -= n
                trades.append((day, p["scode"], p["selection_date"], "SELL", n, price, reason))
        held = [p for p in held if p["left"] > 0]

        def value():
            return sum(p["left"] * next((b.close for b in p["path"] if b.trade_date == day), p["buy_close"] if p["buy_date"] == day else p["price"]) for p in held)

        cap, used = max(0.0, min(money, (money + value()) / 3)), 0.0
        for r in (r for r in scheduled if r.buy_date == day):
            gross = r.shares * r.price
            fee = cents(gross * 0.0002)
            if gross + fee > money or used + gross + fee > cap:
                continue
            money, used, bought, fees = money - gross - fee, used + gross + fee, bought + gross, fees + fee
            held.append(r.asDict() | {"left": r.shares})
            trades.append((day, r.scode, r.selection_date, "BUY", r.shares, r.price, "next_day_average_entry"))
        holdings += [(day, p["scode"], p["selection_date"], p["left"]) for p in held]
        sums.append((day, money, value(), bought, sold, fees, len(held)))
    return trades, holdings, sums


@pytest.mark.parametrize("loss", [0.03, 0.035, 0.06])
def test_portfolio_day_by_day(spark, loss):
    rng = random.Random(int(loss * 1000))
    days = [DAY + dt.timedelta(days=i) for i in range(30)]
    rows = []
    for s in range(14):
        price = 10.0
        for d in days:
            price *= rng.uniform(0.94, 1.07)
            if rng.random() < 0.85:
                o, c = price * rng.uniform(0.97, 1.03), price
                rows.append((f"{s:06}", d, o, c, max(o, c) * rng.uniform(1, 1.08), min(o, c) * rng.uniform(0.94, 1), 10_000.0, price))
    b = spark.createDataFrame(rows, "scode string, trade_date date, open double, close double, high double, low double, volume double, amount double")
    chosen = spark.createDataFrame([(f"{rng.randrange(14):06}", d, 1.0) for d in days[:24] for _ in range(3)], "scode string, trade_date date, score double").dropDuplicates(["scode", "trade_date"])
    calendar = spark.createDataFrame([(d,) for d in days], "trade_date date")
    scheduled = portfolio.schedule(chosen, b)
    ranked = scheduled.withColumn("h", S.stable_rank(7, F.col("scode"), F.col("selection_date"))).orderBy("h", "scode", "selection_date").collect()
    trades, holdings, sums = brute_run(ranked, days, days[20], loss)
    held = portfolio.simulate(scheduled, calendar, str(days[20]), [loss])
    assert len(trades) > 40
    found = sorted((r.trade_date, r.scode, r.selection_date, r.side, r.shares, r.price, r.reason) for r in portfolio.trades(held).collect())
    assert found == sorted(trades)
    assert sorted((r.trade_date, r.scode, r.selection_date, r.shares) for r in portfolio.holdings(held, calendar).collect()) == sorted(holdings)
    for r, want in zip(portfolio.daily(held, calendar).orderBy("trade_date").collect(), sums, strict=True):
        assert (r.trade_date, r.positions) == (want[0], want[-1]) and (r.cash, r.holding, r.bought, r.sold, r.fee) == pytest.approx(want[1:6])
    alone = portfolio.tracked(chosen, b, [loss]).collect()
    assert len(alone) == len(ranked) and all((r.return_rate is None) == (r.sold == 0) for r in alone)
    assert portfolio.pool_run(chosen, b, calendar, str(days[20]), 3, [loss]).count() == held.count()

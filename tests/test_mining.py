"""Names in running text, itemsets and division, against plain versions; hand-made cases of schedules."""

import itertools
import random

import pytest

from tidebar.operators import itemsets, labels, mentions, news, patterns, portfolio


def plain_mentions(rows, terms):
    return sorted((i, t) for i, text in rows for t in {t for t in terms if t} if text and t in text)


NAMES = ["贵州茅台", "茅台", "*ST Supplier", "Supplier#1", "AI", "a", "aa", "平安银行", "ab\nc", "𝔘ni", "", None]
TEXTS = ["AI 贵州茅台发布公告", "Supplier#1, rises", "据悉平安银行，涨；茅台跌", "", None, "aaa", "nothing her", "*ST Supplier#12。", "ab\ncd 𝔘nix", "Supplier #1"]


@pytest.mark.parametrize("limit", [1 << 20, 450, 1])  # broadcast, a few slices, a slice for each term
def test_terms_at_any_place(spark, limit):
    rows = list(enumerate(TEXTS * 7))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, body string, term string").repartition(5)
    terms = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES + NAMES[:3])], "name string, k int")
    found = mentions.mentions(df, terms, "body", "name", slice_bytes=limit)
    assert found.columns == ["id", "term"] or found.columns == ["id", "name"] or "id" in found.columns
    assert sorted((r.id, r[-1]) for r in found.collect()) == plain_mentions(rows, NAMES)


def test_no_terms_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "text")], "id long, text string")
    none = spark.createDataFrame([], "term string")
    assert mentions.mentions(rows, none).count() == 0
    assert mentions.mentions(rows.where("false"), spark.createDataFrame([("t",)], "term string")).count() == 0


def test_stocks_of_one_name_and_codes(spark):
    stocks = spark.createDataFrame([("000001", "平安"), ("000002", "平安"), ("000003", ""), ("000004", None)], "scode string, sname string")
    rows = spark.createDataFrame([(1, "今天平安涨000001。"), (2, "（000003）"), (3, "平")], "id long, text string")
    assert sorted(map(tuple, mentions.stock_mentions(rows, stocks).collect())) == [(1, "000001"), (1, "000002"), (2, "000003")]
    assert sorted(map(tuple, mentions.stock_mentions(rows, stocks, codes=False).collect())) == [(1, "000001"), (1, "000002")]


def test_scores_count_names_in_mid_sentence(spark):
    stocks = spark.createDataFrame([("1", "贵州茅台"), ("2", "Supplier#1"), ("3", "别的")], "scode string, sname string")
    rows = spark.createDataFrame([("AI 贵州茅台发布公告", None, 10, 2, ["AI"]), ("AI", "Supplier#1, rises", None, 2, ["AI", "消费"])], "title string, summary string, heat long, credibility_level int, concepts array<string>")
    heat = spark.createDataFrame([("AI", 0.5)], "concept string, heat double")
    found = {r.scode: r.news_score for r in news.stock_scores(rows, stocks, heat).collect()}
    first, second = 0.5 * 0.9 * (1 + 10 / 100000), 0.5 * 0.9
    assert found["1"] == pytest.approx(first + 0.15 * second) and found["2"] == pytest.approx(0.15 * first + second) and found["3"] == pytest.approx(0.15 * (first + second))


def test_news_near_events(spark):
    events = spark.createDataFrame([("000001", "平安银行", "2026-01-05"), ("000001", "平安银行", "2026-01-20"), ("000002", "万科", "2026-01-05"), ("000003", None, "2026-01-05")], "scode string, sname string, d string").selectExpr("scode", "sname", "cast(d as date) selection_date")
    rows = spark.createDataFrame([("平安银行公告", None, "2026-01-08 09:00:00"), ("万科", "没有词", "2026-01-05 09:00:00"), (None, "x000003公告", "2026-01-02 23:00:00")], "title string, summary string, t string").selectExpr("title", "summary", "cast(t as timestamp) publish_time")
    kept = labels.without_news(events, rows, ["公告"]).collect()
    assert sorted((r.scode, str(r.selection_date)) for r in kept) == [("000001", "2026-01-20"), ("000002", "2026-01-05")]


def plain_itemsets(baskets, least, most):
    counts = {}
    for b in baskets:
        own = sorted({x for x in b or [] if x is not None})
        for k in range(1, most + 1):
            for c in itertools.combinations(own, k):
                counts[c] = counts.get(c, 0) + 1
    return sorted((c, n) for c, n in counts.items() if n >= least)


@pytest.mark.parametrize("least, most, broadcast", [(1, 3, True), (6, 5, True), (9, 6, False), (1000, 4, True)])
def test_itemsets_level_by_level(spark, monkeypatch, least, most, broadcast):
    if not broadcast:
        monkeypatch.setattr(itemsets, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(itemsets, "SLICE_ROWS", 7)
    rng = random.Random(least)
    baskets = [[x for x in "abcdefgh" if rng.random() < 0.55] * rng.choice([1, 2]) for _ in range(40)] + [None, [], [None, "a"], ["hot"] * 3]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    found = itemsets.frequent_itemsets(df, least, most).collect()
    assert sorted((tuple(r["items"]), r.support) for r in found) == plain_itemsets(baskets, least, most)


@pytest.mark.parametrize("broadcast", [True, False])
def test_division(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(itemsets, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(itemsets, "SLICE_ROWS", 4)
    rng = random.Random(4)
    baskets = [(i, ["all"] + [x for x in "abcdefgh" if rng.random() < 0.6]) for i in range(50)] + [(90, []), (91, None)]
    wanted = [[x] for x in "abz"] + [rng.sample("abcdefgh", k) for k in range(2, 9)] + [["all"], [], ["a", "a", "b"], ["a", None]]
    found = itemsets.divided(spark.createDataFrame(baskets, "id long, items array<string>"), spark.createDataFrame(list(enumerate(wanted)), "p int, pattern_items array<string>"))
    want = sorted((i, p) for i, b in baskets for p, w in enumerate(wanted) if w and b and None not in w and set(w) <= set(b))
    assert sorted((r.id, r.p) for r in found.collect()) == want


def test_division_by_more_than_64_items(spark):
    rng = random.Random(5)
    names = [f"t{i:03}" for i in range(150)]
    baskets = [(i, rng.sample(names, 60)) for i in range(40)]
    wanted = [rng.sample(names, rng.randint(1, 4)) for _ in range(120)]
    found = itemsets.divided(spark.createDataFrame(baskets, "id long, items array<string>"), spark.createDataFrame(list(enumerate(wanted)), "p int, pattern_items array<string>"))
    assert sorted((r.id, r.p) for r in found.collect()) == sorted((i, p) for i, b in baskets for p, w in enumerate(wanted) if set(w) <= set(b))


def test_patterns_of_any_size_agree(spark):
    rng = random.Random(8)
    features = spark.createDataFrame([(str(i % 3), i, sorted(x for x in "ABCDEF" if rng.random() < 0.7)) for i in range(60)], "scode string, trade_date int, tokens array<string>")
    events = features.where("trade_date % 4 = 0").select("scode", "trade_date")
    small = patterns.mined(features, events, list("ABCDEF"), 3, 4, (0.1, 0.25), 5)
    large = patterns.mined(features, events, list("ABCDEF"), 4, 4, (0.1, 0.25), 5)
    columns = ["pattern", "positive_support", "sample_count", "success_count", "min_success_rate"]
    assert sorted(map(tuple, large.where("feature_count <= 3").select(columns).collect())) == sorted(map(tuple, small.select(columns).collect())) and small.count() > 20
    assert large.where("feature_count = 4").count() > 0
    assert sorted(map(tuple, patterns.support(events, features, 4).where("feature_count <= 2").select("pattern", "positive_support").collect())) == sorted(map(tuple, patterns.support(events, features, 2).collect()))


def test_schedule_on_the_last_bars(spark):
    bars = [("1", f"2026-01-0{i}", 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 100.0, 1000.0) for i in range(1, 4)]
    b = spark.createDataFrame(bars, "scode string, d string, open double, high double, low double, close double, volume double, amount double").selectExpr("*", "cast(d as date) trade_date").drop("d")
    found = {str(r.selection_date): r for r in portfolio.schedule(b.select("scode", "trade_date"), b).collect()}
    assert sorted(found) == ["2026-01-01", "2026-01-02"] and len(found["2026-01-01"].path) == 1 and len(found["2026-01-02"].path) == 0

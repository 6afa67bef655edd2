"""How much a query moves: pairs that never become rows, one exchange for all that runs along a symbol."""

import itertools
import random

import pytest

from tidebar.operators import bars, datasets, features, patterns
from tidebar.plans import family_queries  # noqa: F401
from tidebar.plans import queries as more
from tidebar.sources import derived

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = [(f"{i % 7}", i, sorted(x for x in "ABCDEF" if rng.random() < 0.6)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "scode string, trade_date int, tokens array<string>").repartition(5)


def test_pairs_are_counted_without_rows_for_each(spark):
    rows, frame = drawn(spark)
    events = spark.createDataFrame([(s, d) for s, d, _ in rows if d % 3 == 0] * 2 + [("none", 1)], "scode string, trade_date int")
    found = patterns.mined(frame, events, list("ABCDEF"))
    assert "Generate explode" not in plan(patterns.pair_counts(patterns.marked(frame, events), list("ABCDEF")))
    want = {}
    for _, d, tokens in rows:
        for k in (1, 2):
            for c in itertools.combinations(tokens, k):
                a, b = want.get(c, (0, 0))
                want[c] = a + 1, b + (d % 3 == 0)
    got = {tuple(r.pattern.split(" && ")): (r.sample_count, r.success_count) for r in found.collect()}
    assert got == {k: v for k, v in want.items() if v[1] >= 1}


@pytest.mark.parametrize("limit", [20_000, 0])
def test_first_matches_and_rates_as_division(spark, monkeypatch, limit):
    monkeypatch.setattr(patterns, "LISTED", limit)
    rows, frame = drawn(spark, seed=5)
    events = frame.where("trade_date % 4 = 0")
    texts = ["A", "B && A", "C && D && E", "A && B && C && D && E && F", "Z", "A && B"]
    wanted = spark.createDataFrame([(t,) for t in texts], "pattern string")
    want = {}
    for t in texts:
        has = [d for _, d, tokens in rows if set(t.split(" && ")) <= set(tokens)]
        if has:
            want[t] = len(has), sum(d % 4 == 0 for d in has)
    assert {r.pattern: (r.sample_count, r.success_count) for r in patterns.rates(wanted, frame, events).collect()} == want
    good = patterns.mined(frame, events, list("ABCDEF")).withColumnRenamed("success_rate", "rate").selectExpr("*", "round(rate, 2) success_rate")
    scores = {tuple(r.pattern.split(" && ")): (r.success_rate, r.pattern) for r in good.collect()}
    best = {(s, d): [scores[c] for k in (1, 2) for c in itertools.combinations(tokens, k) if c in scores] for s, d, tokens in rows}
    got = {(r.scode, r.trade_date): (r.score, r.pattern, r.pattern_count) for r in patterns.best_pattern_per_stock(frame, good, list("ABCDEF")).collect()}
    assert got == {k: (*max(v), len(v)) for k, v in best.items() if v}


def test_days_and_weeks_share_one_exchange(spark):
    b = derived.bars_daily(spark, SMALL)
    df = features.features(b, bars.resample(b, "W", derived.TODAY))
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 + final.count("Exchange hashpartitioning", final.find("ReusedExchange")) and "ReusedExchange" in final


def test_samples_join_nothing(spark):
    """Two rows of one anchor have their own arrays, and neither arrays nor texts go through an exchange."""
    b = spark.createDataFrame([("1", i, float(i)) for i in range(1, 8)] + [("2", 3, 1.0)], "scode string, trade_date int, close double")
    at = spark.createDataFrame([("1", 4, "a"), ("1", 4, "b"), ("1", 9, "c"), ("1", 2, "d"), ("2", 1, "e"), ("3", 1, "f")], "scode string, trade_date int, label string")
    found = {r.label: r.bars and [(x.place, x.close) for x in r.bars] for r in datasets.window_arrays(at, b, 3, ("close",)).collect()}
    assert found == {"a": [(2, 2.0), (3, 3.0), (4, 4.0)], "b": [(2, 2.0), (3, 3.0), (4, 4.0)], "c": [(5, 5.0), (6, 6.0), (7, 7.0)], "d": None, "e": None, "f": None}
    assert "Join" not in plan(more.QUERIES["sample_messages"](spark, SMALL))

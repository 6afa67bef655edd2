"""Registered queries, continued: scans with fallbacks, saved predictions, labelled streams, picks, scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions import scalars as S
from tidebar.operators import bars, datasets, labels, metrics, news, patterns, scans
from tidebar.sources import derived
from tidebar.sources.derived import BARS_SQL, CONCEPTS, NEWS_SQL, STOCKS_SQL

from .more_queries import CONCEPT_SQL, LOW_SQL, POSITIVE_SQL, RANGE, SCORED, THREE_SQL, positives, scored
from .queries import END, START, SURGE_SQL, W, daily, query, rounded


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, nd AS (SELECT DISTINCT CAST(publish_time AS DATE) AS n FROM news WHERE doc_id % 60 NOT IN (10, 11, 12))
    SELECT trade_date, max(n) AS news_date FROM (SELECT DISTINCT trade_date FROM bars WHERE trade_date BETWEEN DATE '2000-12-20' AND DATE '2001-04-01') d LEFT JOIN nd ON n <= trade_date GROUP BY 1""")
def news_day_fallback(spark, d):
    days = scans.between(daily(spark, d), "2000-12-20", "2001-04-01").select("trade_date").distinct()
    return scans.news_days(days, derived.news(spark, d).where("doc_id % 60 NOT IN (10, 11, 12)"))


@query(f"""{SCORED}, {STOCKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, scode) AS n FROM scored WHERE score >= 0.9)
    SELECT trade_date, r.scode, sname, round(score, 6) AS score, 'hash_v1' AS strategy_name, n AS rank_no FROM r LEFT JOIN stocks s ON s.scode = r.scode""")
def prediction_signals(spark, d):
    saved = scans.saved_predictions(scored(spark, d).withColumnRenamed("score", "probability"), "hash_v1", 0.9)
    out = scans.prediction_signals(saved, derived.stocks(spark, d))
    return rounded(out, "score").select("trade_date", "scode", "sname", "score", "strategy_name", F.col("rank_no").cast("long").alias("rank_no"))


@query(f"{SCORED} SELECT scode, trade_date, round(CASE WHEN score >= 0.5 THEN score ELSE -1 END, 6) AS score FROM scored WHERE y = 1")
def score_attach(spark, d):
    s = scored(spark, d)
    out = scans.with_scores(s.where("label = 1").select("scode", "trade_date"), s.where("score >= 0.5"))
    return rounded(out.withColumn("score", F.when(F.col("score") < 0, -1.0).otherwise(F.col("score"))), "score")


@query(f"""WITH RECURSIVE {BARS_SQL}, {THREE_SQL}, placed AS (SELECT scode, trade_date, row_number() OVER ({W}) - 1 AS trade_index FROM bars WHERE {RANGE}),
    rows_ AS (SELECT scode, trade_date, trade_index, label FROM three JOIN placed USING (scode, trade_date) WHERE label <> 'discard'),
    walk AS (SELECT scode, min(trade_index) AS i FROM rows_ WHERE label = 'positive' GROUP BY 1
    UNION ALL SELECT w.scode, (SELECT min(p.trade_index) FROM rows_ p WHERE p.label = 'positive' AND p.scode = w.scode AND p.trade_index > w.i + 20) AS i FROM walk w WHERE w.i IS NOT NULL)
    SELECT scode, trade_date, label FROM rows_ r WHERE label <> 'positive' OR EXISTS (SELECT 1 FROM walk w WHERE w.scode = r.scode AND w.i = r.trade_index)""")
def labelled_stream(spark, d):
    return datasets.labelled_stream(daily(spark, d), START, END).select("scode", "trade_date", "label")


@query(f"WITH {BARS_SQL}, {POSITIVE_SQL}, {LOW_SQL} SELECT count(*) AS n FROM (SELECT scode, trade_date FROM pos INTERSECT SELECT scode, trade_date FROM drops WHERE drop_rate <= -0.06)")
def key_overlap(spark, d):
    return scans.overlap(positives(spark, d), labels.drop6_labels(daily(spark, d)).where("label = 1"))


@query(f"""WITH {BARS_SQL}, {SURGE_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY start_rise_date, scode) - 1 AS n, count(*) OVER () AS c FROM surges)
    SELECT scode, start_rise_date FROM n WHERE c <= 10 OR n IN (SELECT CAST(round_even(i * (c - 1) / 9.0, 0) AS BIGINT) FROM range(10) r(i), (SELECT max(c) AS c FROM n))""")
def evenly_spaced_events(spark, d):
    return patterns.evenly_spaced(labels.surge_events(daily(spark, d), START, END).select("scode", "start_rise_date"), ["start_rise_date", "scode"], 10)


@query(f"""WITH {BARS_SQL}, {LOW_SQL}, a AS (SELECT scode, CAST(trade_date + CAST(1 AS INTEGER) AS DATE) AS trade_date FROM bars WHERE day(trade_date) = 14)
    SELECT a.scode, a.trade_date, coalesce(drop_rate <= -0.06, false) AS is_drop6 FROM a LEFT JOIN drops b ON a.scode = b.scode AND a.trade_date = b.trade_date""")
def anchor_classes(spark, d):
    b = daily(spark, d)
    anchors = b.where("day(trade_date) = 14").select("scode", F.date_add("trade_date", 1).alias("trade_date"))
    return labels.classify_anchors(anchors, b)


@query(f"""WITH {NEWS_SQL}, {CONCEPT_SQL}, heats AS (SELECT concept, count(*) / (SELECT count(*) FROM news) AS h FROM (SELECT unnest(concepts) AS concept FROM concepts) GROUP BY 1),
    flat AS (SELECT news_link, unnest(concepts) AS concept FROM concepts) SELECT news_link, round(max(h), 6) AS hottest, count(*) AS n FROM flat JOIN heats USING (concept) GROUP BY 1""")
def attached_heat(spark, d):
    rows = news.with_concept_heat(news.with_concepts(derived.news(spark, d), CONCEPTS)).where(F.size("concept_heat") > 0)
    return rounded(rows.select("news_link", F.array_max(F.transform("concept_heat", lambda h: h["heat"])).alias("hottest"), F.size("concept_heat").cast("long").alias("n")), "hottest")


@query("SELECT s_suppkey, lpad(right(CAST(s_suppkey AS VARCHAR), 6), 6, '0') AS scode, CASE WHEN s_suppkey % 10 >= 8 OR s_suppkey % 10 = 4 THEN 'bj' WHEN s_suppkey % 10 IN (5, 6) THEN 'sh' ELSE 'sz' END AS exchange FROM supplier")
def symbol_scalars(spark, d):
    key = F.col("s_suppkey").cast("string")
    return derived.table(spark, d, "supplier").select("s_suppkey", S.normalize_symbol(F.concat(F.lit("sh."), key)).alias("scode"), S.exchange_of(F.concat((F.col("s_suppkey") % 10).cast("string"), F.lit("00001"))).alias("exchange"))


@query(f"{SCORED} SELECT scode, trade_date, round(exp(-score) / (exp(-score) + exp(-down) + exp(-0.5)), 6) AS positive, round((exp(-score) - 0.5 * exp(-down)) / (exp(-score) + exp(-down) + exp(-0.5)), 6) AS selection FROM scored")
def class_probabilities(spark, d):
    p = S.class_probabilities({"positive": F.col("score"), "negative": F.col("down"), "neutral": F.lit(0.5)})
    return rounded(scored(spark, d).select("scode", "trade_date", p["positive"].alias("positive"), S.selection_score(p["positive"], p["negative"], p["neutral"]).alias("selection")), "positive", "selection")


@query(f"""{SCORED}, n AS (SELECT *, (row_number() OVER (ORDER BY scode, trade_date) - 1) // 1000 AS chunk FROM scored)
    SELECT chunk, count(*) FILTER (score >= 0.7 AND y = 1) AS tp, count(*) FILTER (score >= 0.7 AND y = 0) AS fp, count(*) FILTER (score < 0.7 AND y = 1) AS fn, count(*) FILTER (score < 0.7 AND y = 0) AS tn FROM n GROUP BY 1""")
def chunked_confusion(spark, d):
    rows = scored(spark, d).select("scode", "trade_date", F.col("score").alias("s"), F.col("label").alias("y"))
    return metrics.chunked_confusion(rows, ["scode", "trade_date"], 0.7, score="s", label="y")


@query(f"WITH {BARS_SQL} SELECT scode, trade_date, round(close, 6) AS close FROM bars WHERE trade_date BETWEEN DATE '1999-12-02' AND DATE '2000-02-10' AND scode IN ('000001', '000003')")
def symbol_range_scan(spark, d):
    rows = scans.between(daily(spark, d), "2000-01-01", "2000-01-31", 30, 10, ["000001", "000003"])
    return rounded(rows.select("scode", "trade_date", "close"), "close")


@query(f"WITH {BARS_SQL} SELECT max(trade_date) AS trade_date FROM bars")
def latest_day(spark, d):
    return bars.latest_day(daily(spark, d))

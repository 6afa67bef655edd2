"""Registered queries, continued: labels, sample sets, metrics, news, raw sources, portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions import scalars as S
from tidebar.operators import bars, datasets, labels, mentions, metrics, news, patterns, portfolio, signals
from tidebar.sources import derived, raw, store
from tidebar.sources.derived import BARS_SQL, CONCEPTS, NEWS_SQL, STOCKS_SQL, TODAY

from .queries import END, START, W, daily, query, rounded, weekly

RANGE = f"trade_date BETWEEN DATE '{START}' AND DATE '{END}'"

LEADS_SQL = ", ".join(f"lead({c}, {i}) OVER ({W}) AS {c}_{i}" for c in ("high", "low") for i in (1, 2, 3))
THREE_SQL = f"""three AS (SELECT scode, trade_date, CASE
        WHEN high_1 >= 1.2 * close AND low_1 <= 0.94 * close THEN 'discard' WHEN high_1 >= 1.2 * close THEN 'positive' WHEN low_1 <= 0.94 * close THEN 'negative'
        WHEN high_2 >= 1.2 * close AND low_2 <= 0.94 * close THEN 'discard' WHEN high_2 >= 1.2 * close THEN 'positive' WHEN low_2 <= 0.94 * close THEN 'negative'
        WHEN high_3 >= 1.2 * close AND low_3 <= 0.94 * close THEN 'discard' WHEN high_3 >= 1.2 * close THEN 'positive' WHEN low_3 <= 0.94 * close THEN 'negative' ELSE 'neutral' END AS label
    FROM (SELECT *, {LEADS_SQL} FROM bars) WHERE high_3 IS NOT NULL AND close > 0)"""


@query(f"WITH {BARS_SQL}, {THREE_SQL} SELECT * FROM three")
def threeclass_labels(spark, d):
    return labels.threeclass_labels(daily(spark, d)).select("scode", "trade_date", "label")


LOW_SQL = f"""lows AS (SELECT *, row_number() OVER ({W}) - 1 AS trade_index, CASE WHEN count(low) OVER f = 3 THEN min(low) OVER f END AS min_low FROM bars WINDOW f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
    drops AS (SELECT scode, trade_date, trade_index, (min_low - close) / close AS drop_rate FROM lows WHERE min_low IS NOT NULL AND close > 0)"""


@query(f"""WITH {BARS_SQL}, {LOW_SQL} SELECT scode, trade_date, round(drop_rate, 6) AS drop_rate, 1 AS label FROM drops WHERE drop_rate <= -0.06
    UNION ALL SELECT scode, trade_date, round(drop_rate, 6), 0 FROM drops a WHERE drop_rate > -0.06 AND NOT EXISTS (SELECT 1 FROM drops b WHERE b.scode = a.scode AND b.drop_rate <= -0.06 AND b.trade_index BETWEEN a.trade_index - 10 AND a.trade_index + 10)""")
def drop6_labels(spark, d):
    return rounded(labels.drop6_labels(daily(spark, d)), "drop_rate").select("scode", "trade_date", "drop_rate", "label")


@query(f"""WITH {BARS_SQL}, k AS (SELECT scode, trade_date, trade_index, CASE WHEN least(low_1, low_2, low_3) <= 0.94 * close THEN 'down6' WHEN greatest(high_1, high_2, high_3) >= 1.2 * close THEN 'surge' ELSE 'neutral' END AS label
        FROM (SELECT *, row_number() OVER ({W}) - 1 AS trade_index, {LEADS_SQL} FROM bars) WHERE high_3 IS NOT NULL AND close > 0)
    SELECT scode, trade_date, label FROM k a WHERE label = 'down6' OR (label = 'neutral' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.label = 'surge' AND b.scode = a.scode AND b.trade_index BETWEEN a.trade_index - 20 AND a.trade_index + 20))""")
def down6_neutral_labels(spark, d):
    return labels.down6_neutral_labels(daily(spark, d)).select("scode", "trade_date", "label")


POSITIVE_SQL = f"{THREE_SQL}, placed AS (SELECT scode, trade_date, row_number() OVER ({W}) - 1 AS trade_index FROM bars), pos AS (SELECT scode, trade_date, trade_index FROM placed JOIN three USING (scode, trade_date) WHERE label = 'positive' AND {RANGE})"


def positives(spark, d):
    b = daily(spark, d)
    marked = labels.threeclass_labels(b).where(f"label = 'positive' AND {RANGE}")
    return marked.join(bars.with_index(b).select("scode", "trade_date", "trade_index"), ["scode", "trade_date"]).select("scode", "trade_date", "trade_index")


@query(f"WITH {BARS_SQL}, {POSITIVE_SQL} SELECT scode, trade_date FROM placed a WHERE EXISTS (SELECT 1 FROM pos p WHERE p.scode = a.scode AND a.trade_index BETWEEN p.trade_index - 20 AND p.trade_index + 20)")
def exclusion_window(spark, d):
    rows = bars.with_index(daily(spark, d)).select("scode", "trade_date", "trade_index")
    return labels.near_positions(rows, positives(spark, d), 20).select("scode", "trade_date")


@query(f"""WITH RECURSIVE {BARS_SQL}, {POSITIVE_SQL}, walk AS (SELECT scode, min(trade_index) AS i FROM pos GROUP BY 1
    UNION ALL SELECT w.scode, (SELECT min(p.trade_index) FROM pos p WHERE p.scode = w.scode AND p.trade_index > w.i + 20) AS i FROM walk w WHERE w.i IS NOT NULL)
    SELECT scode, i AS trade_index FROM walk WHERE i IS NOT NULL""")
def cooldown_keep(spark, d):
    return datasets.cooldown(positives(spark, d), 20).select("scode", F.col("trade_index").cast("long").alias("trade_index"))


def rank_sql(seed: int, *parts: str) -> str:
    return f"substr(sha256(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 16)"


@query(f"""WITH {BARS_SQL}, {POSITIVE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY {rank_sql(7, 'scode', 'trade_date')}, scode, trade_date) AS n, count(*) OVER () AS c FROM pos)
    SELECT scode, trade_date, n <= CASE WHEN c > 1 THEN greatest(1, round_even(0.2 * c, 0)) ELSE 0 END AS is_eval FROM r""")
def hash_split(spark, d):
    return datasets.hash_split(positives(spark, d), 7, ["scode", "trade_date"]).select("scode", "trade_date", "is_eval")


@query(f"""WITH {BARS_SQL}, {POSITIVE_SQL} SELECT scode, trade_date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.scode = b.scode AND p.trade_date = b.trade_date) ORDER BY {rank_sql(7, 'scode', 'trade_date')}, scode, trade_date LIMIT 500""")
def negatives_antijoin(spark, d):
    return datasets.negatives(daily(spark, d), positives(spark, d), 7, 500).select("scode", "trade_date")


REBALANCE_SQL = f"""ranked AS (SELECT scode, trade_date, label, {rank_sql(7, "'rebalance'", 'scode', 'trade_date')} AS hash_rank FROM three WHERE label <> 'discard'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY trade_date, label ORDER BY hash_rank, scode, trade_date) AS n FROM ranked),
    days AS (SELECT trade_date, least(count(*) FILTER (label = 'positive'), count(*) FILTER (label = 'negative') // 4, count(*) FILTER (label = 'neutral') // 11) AS cycles FROM three GROUP BY 1),
    balanced AS (SELECT scode, trade_date, label, hash_rank, CAST(ceil(n / CASE label WHEN 'negative' THEN 4.0 WHEN 'neutral' THEN 11.0 ELSE 1.0 END) AS BIGINT) AS cycle, cycles FROM numbered JOIN days USING (trade_date))"""


MONTHS_SQL = """three AS (SELECT scode, CAST(date_trunc('month', trade_date) AS DATE) AS trade_date, arg_min(CASE WHEN k = 0 THEN 'positive' WHEN k < 5 THEN 'negative' ELSE 'neutral' END, trade_date) AS label
    FROM (SELECT *, (CAST(('0x' || substr(sha256(scode || CAST(trade_date AS VARCHAR)), 1, 8)) AS BIGINT)) % 16 AS k FROM bars) GROUP BY 1, 2)"""


def threeclass_hashed(spark, d):
    """Month rows of symbols with labels by a hash in the ratio 1 : 4 : 11, so that cycles exist at every size."""
    k = F.conv(F.substring(F.sha2(F.concat("scode", F.col("trade_date").cast("string")), 256), 1, 8), 16, 10).cast("long") % 16
    rows = daily(spark, d).select("scode", "trade_date", F.when(k == 0, "positive").when(k < 5, "negative").otherwise("neutral").alias("label"))
    return rows.groupBy("scode", F.trunc("trade_date", "month").alias("month")).agg(F.min_by("label", "trade_date").alias("label")).withColumnRenamed("month", "trade_date")


@query(f"WITH {BARS_SQL}, {MONTHS_SQL}, {REBALANCE_SQL} SELECT scode, trade_date, label, cycle FROM balanced WHERE cycle <= cycles")
def rebalance_same_date(spark, d):
    return datasets.rebalance_same_date(threeclass_hashed(spark, d), 7).select("scode", "trade_date", "label", "cycle")


@query(f"""WITH {BARS_SQL}, {MONTHS_SQL}, {REBALANCE_SQL} SELECT scode, trade_date, label, cycle, {rank_sql(7, "'date'", 'trade_date')} AS date_rank, row_number() OVER (PARTITION BY trade_date ORDER BY cycle, hash_rank, scode) AS place FROM balanced WHERE cycle <= cycles""")
def cycle_interleave(spark, d):
    out = datasets.interleave(threeclass_hashed(spark, d), 7)
    return out.select("scode", "trade_date", "label", "cycle", "date_rank", F.col("place").cast("long").alias("place"))


@query(f"""WITH {BARS_SQL}, {MONTHS_SQL}, c AS (SELECT least(count(*) FILTER (label = 'positive'), count(*) FILTER (label = 'negative') // 4, count(*) FILTER (label = 'neutral') // 11) AS cycles FROM three),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(7, "'evaluation'", 'scode', 'trade_date')}, scode, trade_date) AS n FROM three)
    SELECT scode, trade_date, label FROM r, c WHERE n <= cycles * CASE label WHEN 'negative' THEN 4 WHEN 'neutral' THEN 11 ELSE 1 END""")
def evaluation_set(spark, d):
    return datasets.evaluation_set(threeclass_hashed(spark, d), 7).select("scode", "trade_date", "label")


@query(f"""WITH {BARS_SQL}, {THREE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(7, "'split'", 'scode', 'trade_date')}, scode, trade_date) AS n, count(*) OVER (PARTITION BY label) AS c FROM three)
    SELECT scode, trade_date, label, n <= round_even(0.8 * c, 0) AS is_train FROM r""")
def stratified_split(spark, d):
    rows = labels.threeclass_labels(daily(spark, d)).select("scode", "trade_date", "label")
    return datasets.stratified_split(rows, 0.8, 7).select("scode", "trade_date", "label", "is_train")


@query(f"""WITH {BARS_SQL}, {STOCKS_SQL}, last AS (SELECT s.scode, sname, max(trade_date) AS latest FROM stocks s LEFT JOIN bars b ON b.scode = s.scode GROUP BY 1, 2),
    cut AS (SELECT min(trade_date) AS cutoff FROM (SELECT DISTINCT trade_date FROM bars ORDER BY 1 DESC LIMIT 11))
    SELECT scode, sname, latest FROM last, cut WHERE contains(sname, '退市') OR starts_with(sname, '退') OR starts_with(upper(sname), 'PT') OR ends_with(sname, '退') OR latest IS NULL OR latest < cutoff""")
def abnormal_symbols(spark, d):
    return bars.abnormal_symbols(derived.stocks(spark, d), daily(spark, d))


@query(f"WITH {STOCKS_SQL} SELECT scode, sname, contains(upper(replace(sname, ' ', '')), 'ST') OR contains(upper(replace(sname, ' ', '')), 'PT') AS special FROM stocks")
def st_filter(spark, d):
    return derived.stocks(spark, d).select("scode", "sname", S.is_special_name(F.col("sname")).alias("special"))


@query(f"""WITH {BARS_SQL}, a AS (SELECT scode, trade_date, list(CAST(round(close * 100 + 1e-6) AS BIGINT)) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM bars)
    SELECT scode, trade_date, CASE WHEN len(c) = 5 THEN array_to_string(c, ',') END AS closes FROM a WHERE day(trade_date) = 15""")
def window_arrays(spark, d):
    b = daily(spark, d)
    found = datasets.window_arrays(b.where("day(trade_date) = 15").select("scode", "trade_date"), b, 5, ("close",))
    return found.select("scode", "trade_date", F.array_join(F.transform("bars", lambda x: F.round(x["close"] * 100 + 1e-6).cast("long").cast("string")), ",").alias("closes"))


def words_sql(column: str, word: str) -> str:
    return f"((length({column}) - length(replace({column}, '{word}', ''))) // {len(word)})"


CONCEPT_SQL = "concepts AS (SELECT *, list_transform(list_sort(list_filter([" + ", ".join(
    f"{{'score': -({' + '.join(f'3 * {words_sql("title", w)} + {words_sql("summary", w)}' for w in words)}), 'name': '{name}'}}" for name, words in CONCEPTS.items()) + "], lambda x: x.score < 0)), lambda x: x.name) AS concepts FROM news)"


@query(f"WITH {NEWS_SQL}, {CONCEPT_SQL} SELECT news_link, array_to_string(concepts, ',') AS concepts FROM concepts")
def related_concepts(spark, d):
    return news.with_concepts(derived.news(spark, d), CONCEPTS).select("news_link", F.array_join("concepts", ",").alias("concepts"))


@query(f"WITH {NEWS_SQL}, {CONCEPT_SQL} SELECT concept, round(count(*) / (SELECT count(*) FROM news), 6) AS heat FROM (SELECT unnest(concepts) AS concept FROM concepts) GROUP BY 1")
def concept_heat(spark, d):
    return rounded(news.concept_heat(news.with_concepts(derived.news(spark, d), CONCEPTS)), "heat")


HEAT_SQL = "heats AS (SELECT concept, count(*) / (SELECT count(*) FROM news) AS ch FROM (SELECT unnest(concepts) AS concept FROM concepts) GROUP BY 1)"
KEYS_SQL = "keys(concept, words) AS (VALUES " + ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in CONCEPTS.items()) + ")"
#: Every fifth text names a stock in the middle of a sentence, unspaced, and every fifth gives its code.
NAMED_SQL = """(substring(coalesce(summary, ''), 1, 30) || CASE WHEN doc_id % 5 = 0 THEN '据悉' || (CASE WHEN doc_id % 20 % 7 = 3 THEN '*ST ' WHEN doc_id % 20 % 11 = 5 THEN '退市' ELSE '' END) || 'Supplier#' || lpad(CAST(doc_id % 20 AS VARCHAR), 9, '0') || '，发布公告'
    WHEN doc_id % 5 = 1 THEN '（' || lpad(CAST(doc_id % 10 AS VARCHAR), 6, '0') || '）' ELSE '' END || substring(coalesce(summary, ''), 31))"""
SCORES_SQL = f"""{CONCEPT_SQL}, {HEAT_SQL}, {KEYS_SQL}, flat AS (SELECT coalesce(title, '') || ' ' || {NAMED_SQL} AS text,
        heat, credibility_level, c.concept, c.rank FROM concepts, LATERAL (SELECT unnest(concepts) AS concept, generate_subscripts(concepts, 1) AS rank) c),
    weighed AS (SELECT f.*, ch * (11 - rank) / 10.0 * (11 - credibility_level) / 10.0 * (1 + least(coalesce(heat, 0), 100000) / 100000) AS weight, len(list_filter(words, lambda w: contains(text, w))) * 0.15 AS kw FROM flat f JOIN heats USING (concept) JOIN keys USING (concept)),
    per AS (SELECT s.scode, w.concept, sum(weight * least(1.0, kw + CASE WHEN contains(text, sname) THEN 1.0 ELSE 0.0 END)) AS score FROM stocks s, weighed w GROUP BY 1, 2 HAVING score > 0)"""


def with_names(rows):
    """News that names stocks in mid-sentence, as NAMED_SQL does."""
    key, summary = F.col("doc_id") % 20, F.coalesce("summary", F.lit(""))
    named = F.concat(F.lit("据悉"), derived.name_prefix(key), F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"), F.lit("，发布公告"))
    code = F.concat(F.lit("（"), F.lpad((F.col("doc_id") % 10).cast("string"), 6, "0"), F.lit("）"))
    middle = F.when(F.col("doc_id") % 5 == 0, named).when(F.col("doc_id") % 5 == 1, code).otherwise("")
    return rows.withColumn("__summary", summary).withColumn("summary", F.concat(F.substring("__summary", 1, 30), middle, F.expr("substring(__summary, 31)"))).drop("__summary")


def named_news(spark, d):
    return with_names(news.with_concepts(derived.news(spark, d), CONCEPTS))


@query(f"""WITH {NEWS_SQL}, {STOCKS_SQL}, texts AS (SELECT news_link, coalesce(title, '') || ' ' || {NAMED_SQL} AS text FROM news)
    SELECT news_link, scode FROM texts JOIN stocks ON contains(text, sname) OR contains(text, scode)""")
def stock_mentions(spark, d):
    """The stocks that each news row names, by name or code, anywhere in its text."""
    rows = named_news(spark, d).select("news_link", F.concat_ws(" ", F.coalesce("title", F.lit("")), "summary").alias("text"))
    return mentions.stock_mentions(rows, derived.stocks(spark, d))


def plain_stocks(spark, d):
    return derived.stocks(spark, d)


@query(f"WITH {NEWS_SQL}, {STOCKS_SQL}, {SCORES_SQL} SELECT scode, round(sum(score), 6) AS news_score FROM per GROUP BY 1")
def stock_news_scores(spark, d):
    rows = named_news(spark, d)
    return rounded(news.stock_scores(rows, plain_stocks(spark, d), news.concept_heat(rows), CONCEPTS), "news_score").select("scode", "news_score")


@query(f"""WITH {BARS_SQL}, {NEWS_SQL}, {STOCKS_SQL}, {SCORES_SQL}, scores AS (SELECT scode, round(sum(score), 6) AS news_score FROM per GROUP BY 1)
    SELECT scode, round(0.65 * news_score + 0.35 * coalesce(p, 0), 6) AS score FROM scores LEFT JOIN (SELECT scode, 0.01 * (CAST(scode AS INTEGER) % 13) AS p FROM stocks) USING (scode) ORDER BY score DESC, scode LIMIT 5""")
def news_hot(spark, d):
    rows = named_news(spark, d)
    scores = rounded(news.stock_scores(rows, plain_stocks(spark, d), news.concept_heat(rows), CONCEPTS), "news_score")
    performance = plain_stocks(spark, d).select("scode", (0.01 * (F.col("scode").cast("int") % 13)).alias("performance"))
    return rounded(news.news_hot(scores, performance), "score").select("scode", "score")


@query(f"""WITH {NEWS_SQL} SELECT news_link, contains(title || ' ' || summary, 'the') OR contains(title || ' ' || summary, 'der') AS told FROM news WHERE title IS NOT NULL""")
def message_keyword_flag(spark, d):
    told = S.message_driven(F.col("title"), F.col("summary"), F.lit(" "), F.lit("#"), ["the", "der"])
    plain = F.contains(F.concat_ws(" ", "title", "summary"), F.lit("the")) | F.contains(F.concat_ws(" ", "title", "summary"), F.lit("der"))
    return derived.news(spark, d).where("title IS NOT NULL").select("news_link", F.when(told, True).otherwise(plain).alias("told"))


@query("""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(t, '10送([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS bonus, TRY_CAST(nullif(regexp_extract(t, '10派([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS cash
    FROM (SELECT p_partkey, '10送' || p_size || '股, 10派' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || '元' AS t FROM part)""")
def exrights_ratio_regex(spark, d):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("10送"), size, F.lit("股, 10派"), size, F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("元"))
    return derived.table(spark, d, "part").select("p_partkey", S.number_before(text, "送").alias("bonus"), S.number_before(text, "派").alias("cash"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 10000 + 5000 ELSE p_size * 1000 END AS BIGINT) AS heat FROM part")
def heat_parse(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(".5万"))).otherwise(F.concat(size, F.lit(",000")))
    return derived.table(spark, d, "part").select("p_partkey", S.parse_heat(text).alias("heat"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return derived.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("""SELECT conv_id, string_agg(role || ':' || length(coalesce(text, '')), ',' ORDER BY turn, role, text) AS messages FROM conversations GROUP BY 1""")
def chat_messages(spark, d):
    out = raw.chat_samples(derived.table(spark, d, "conversations"))
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.char_length(F.coalesce(m["content"], F.lit(""))).cast("string"))), ",").alias("messages"))


SCORED_SQL = f"""scored AS (SELECT scode, trade_date, label, CAST(label = 'positive' AS INTEGER) AS y, CAST(('0x' || substr(sha256(scode || '|' || CAST(trade_date AS VARCHAR)), 1, 6)) AS BIGINT) / 16777216.0::DOUBLE AS score,
    CAST(('0x' || substr(sha256('down|' || scode || '|' || CAST(trade_date AS VARCHAR)), 1, 6)) AS BIGINT) / 16777216.0::DOUBLE AS down,
    CASE WHEN ('0x' || substr(sha256('p|' || scode || '|' || CAST(trade_date AS VARCHAR)), 1, 2))::BIGINT < 120 THEN label ELSE 'neutral' END AS predicted FROM three WHERE label <> 'discard')"""


def scored(spark, d):
    """Labelled rows with scores that follow from a hash of the key, as a stand-in for a model."""
    def number(prefix: str):
        return F.conv(F.substring(F.sha2(F.concat_ws("|", *([F.lit(prefix)] if prefix else []), "scode", F.col("trade_date").cast("string")), 256), 1, 6), 16, 10).cast("long") / 16777216.0

    rows = labels.threeclass_labels(daily(spark, d)).where("label <> 'discard'")
    coin = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("p"), "scode", F.col("trade_date").cast("string")), 256), 1, 2), 16, 10).cast("long") < 120
    return rows.select("scode", "trade_date", F.col("label").alias("actual"), (F.col("label") == "positive").cast("int").alias("label"), number("").alias("score"), number("down").alias("down"), F.when(coin, F.col("label")).otherwise("neutral").alias("predicted"))


SCORED = f"WITH {BARS_SQL}, {THREE_SQL}, {SCORED_SQL}"


@query(f"{SCORED}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, scode, trade_date) AS n FROM scored) SELECT CAST(k AS INTEGER) AS k, round(count(CASE WHEN y = 1 THEN 1 END) / count(*), 6) AS precision FROM t, (VALUES (5), (10), (20), (50), (100), (200), (500)) v(k) WHERE n <= k GROUP BY k")
def precision_at_k(spark, d):
    return rounded(metrics.precision_at(scored(spark, d), ["scode", "trade_date"]), "precision")


@query(f"""{SCORED} SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM (SELECT count(*) FILTER (score >= 0.7 AND y = 1) AS tp, count(*) FILTER (score >= 0.7 AND y = 0) AS fp, count(*) FILTER (score < 0.7 AND y = 1) AS fn, count(*) FILTER (score < 0.7 AND y = 0) AS tn FROM scored)""")
def binary_confusion(spark, d):
    return rounded(metrics.binary_confusion(scored(spark, d), 0.7), "precision", "recall")


@query(f"{SCORED} SELECT label AS actual, predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def threeclass_confusion(spark, d):
    return metrics.confusion(scored(spark, d))


@query(f"""{SCORED}, c AS (SELECT k AS class, count(*) FILTER (label = k AND predicted = k) AS tp, count(*) FILTER (label = k) AS a, count(*) FILTER (predicted = k) AS p FROM scored, (VALUES ('positive'), ('negative'), ('neutral')) v(k) GROUP BY 1),
    r AS (SELECT class, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN a > 0 THEN tp / a ELSE 0 END AS re, a FROM c) SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, a AS support, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r""")
def class_report(spark, d):
    return rounded(metrics.class_report(scored(spark, d)), "precision", "recall", "f1")


@query(f"{SCORED} SELECT round(avg(score) + 0.7 * (max(score) - avg(score)), 6) AS threshold FROM scored")
def next_threshold(spark, d):
    return rounded(metrics.next_threshold(scored(spark, d), 0.7), "threshold")


@query(f"{SCORED} SELECT round(count(*) FILTER (y = 1 AND score < 0.45) / count(*) FILTER (y = 1), 6) AS low_score_rate FROM scored")
def low_score_rate(spark, d):
    return rounded(metrics.low_score_rate(scored(spark, d)), "low_score_rate")


@query(f"{SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, scode, trade_date LIMIT 200) SELECT scode, trade_date, round(score - 0.3 * down, 6) AS combined, row_number() OVER (ORDER BY score - 0.3 * down DESC, scode, trade_date) AS rank_no FROM t")
def joint_rerank(spark, d):
    s = scored(spark, d)
    out = metrics.joint_rerank(s.select("scode", "trade_date", F.col("score").alias("up")), s.select("scode", "trade_date", "down"), 200, 0.3, ["scode", "trade_date"])
    return rounded(out, "combined").select("scode", "trade_date", "combined", F.col("rank_no").cast("long").alias("rank_no"))


@query(f"""{SCORED}, g AS (SELECT s.*, w, row_number() OVER (PARTITION BY w ORDER BY score - w * down DESC, scode, trade_date) AS n FROM scored s, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(w)) SELECT w AS weight, round(count(*) FILTER (y = 1) / count(*), 6) AS precision FROM g WHERE n <= 50 GROUP BY 1""")
def weight_sweep(spark, d):
    rows = scored(spark, d).withColumnRenamed("score", "up")
    return rounded(metrics.weight_sweep(rows, patterns.weight_grid("0", "1", "0.25"), ["scode", "trade_date"], 50), "precision")


@query(f"{SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY score DESC) AS r FROM scored) SELECT r AS rank, count(*) AS groups FROM r WHERE y = 1 GROUP BY 1")
def group_ranks(spark, d):
    return metrics.group_ranks(scored(spark, d), ["trade_date"]).select(F.col("rank").cast("long").alias("rank"), "groups")


@query("SELECT CAST(l_shipdate AS DATE) AS selection_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS scode, min(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER)) AS trade_date, max(l_returnflag) AS sname, count(DISTINCT l_linestatus) AS rules FROM lineitem GROUP BY 1, 2")
def pool_group(spark, d):
    rows = derived.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("selection_date"), S.normalize_symbol(F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("scode"),
                                                     F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int")).alias("trade_date"), F.col("l_returnflag").alias("sname"), F.col("l_linestatus").alias("rule"))
    return portfolio.pool(rows)


@query("SELECT l_returnflag AS side, l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2")
def reason_counts(spark, d):
    return portfolio.reason_counts(derived.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_linestatus").alias("reason")))


@query("""WITH x AS (SELECT c_custkey, sha256(concat_ws('|', c_name, c_mktsegment)) AS h FROM customer) SELECT c_custkey, h AS content_hash FROM x WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def content_hash_diff(spark, d):
    rows = derived.table(spark, d, "customer").select("c_custkey", S.joined_hash(F.col("c_name"), F.col("c_mktsegment")).alias("content_hash"))
    stored = rows.where("c_custkey % 3 <> 0").withColumn("content_hash", F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return bars.changed_rows(rows, stored, "c_custkey", "content_hash")


TRADES_SQL = """trades AS (SELECT l_suppkey AS scode, CAST(l_orderkey % 3 AS INTEGER) AS selection_date, CASE WHEN l_linenumber % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS shares, 20 + l_extendedprice / 10000 AS price, l_orderkey AS o, l_linenumber AS l, l_partkey AS p FROM lineitem)"""


@query(f"""WITH {TRADES_SQL}, e AS (SELECT *, shares * price AS gross, sum(shares) OVER (PARTITION BY scode, selection_date, side ORDER BY o, l, p, shares, price ROWS UNBOUNDED PRECEDING) AS s1 FROM trades),
    b AS (SELECT scode, selection_date, s1 - shares AS b0, s1 AS b1, price AS bp FROM e WHERE side = 'BUY'),
    m AS (SELECT s.scode, s.selection_date, s.o, s.l, s.p, s.gross, coalesce(sum(greatest(0, least(s1, b1) - greatest(s1 - shares, b0)) * bp), 0) AS cost FROM e s LEFT JOIN b USING (scode, selection_date) WHERE side = 'SELL' GROUP BY ALL)
    SELECT scode, selection_date, o, l, p, round(cost, 4) AS buy_cost, round(gross - cost, 4) AS realized_pnl FROM m""")
def fifo_realized_pnl(spark, d):
    rows = derived.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("scode"), (F.col("l_orderkey") % 3).cast("int").alias("selection_date"), F.when(F.col("l_linenumber") % 2 == 0, "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").cast("long").alias("shares"),
        (20 + F.col("l_extendedprice") / 10000).alias("price"), F.lit(0.0).alias("fee"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"))
    out = portfolio.realized(rows.withColumn("gross", F.col("shares") * F.col("price")), ["o", "l", "p", "shares", "price"])
    return rounded(out, "buy_cost", "realized_pnl", digits=4).select("scode", "selection_date", "o", "l", "p", "buy_cost", "realized_pnl")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def upsert_result(spark, d):
    rows = derived.table(spark, d, "customer").select("c_custkey", "c_name")
    return store.merged(rows.where("c_custkey % 8 <> 0"), rows.where("c_custkey % 4 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query(f"WITH {BARS_SQL} SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS day_index, coalesce(month(lead(trade_date) OVER (ORDER BY trade_date)) <> month(trade_date), true) AS ends_month FROM (SELECT DISTINCT trade_date FROM bars)")
def trade_calendar(spark, d):
    return bars.calendar(daily(spark, d)).withColumn("day_index", F.col("day_index").cast("long"))


@query(f"WITH {BARS_SQL}, {STOCKS_SQL} SELECT s.scode, sname, nation, max(trade_date) AS latest FROM stocks s LEFT JOIN bars b ON b.scode = s.scode GROUP BY 1, 2, 3")
def cursor_state(spark, d):
    return bars.cursors(derived.stocks(spark, d), daily(spark, d))


def simulated(spark, d):
    """(positions bought, trading days): signals of the moving averages, cooled and limited, under all stop-loss rules."""
    b = daily(spark, d)
    days = bars.calendar(b)
    found = signals.ma_bullish(b).join(derived.stocks(spark, d).select("scode", "sname"), "scode")
    chosen = portfolio.selected(found, days, limit=3)
    scheduled = portfolio.schedule(chosen.select("scode", "trade_date", "score"), b)
    wanted = days.select("trade_date")
    return portfolio.simulate(scheduled, wanted, TODAY), wanted


@query()
def portfolio_daily(spark, d):
    return rounded(portfolio.daily(*simulated(spark, d)), "cash", "holding", "total", "bought", "sold", "fee", digits=2)


@query()
def portfolio_trades(spark, d):
    return rounded(portfolio.trades(simulated(spark, d)[0]), "price", "gross", "fee", "stamp", digits=2)


@query()
def portfolio_holdings(spark, d):
    return rounded(portfolio.holdings(*simulated(spark, d)), "price", "value", digits=2)

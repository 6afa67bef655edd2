"""Market-bar views over the star-schema tables, for queries, tests and benchmarks; each has its text for DuckDB beside it.

bars: daily bars of suppliers from line items. stocks: suppliers, some with names that filters must catch. news: documents as news rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed last day of the views; never the current date.
TODAY = "2001-11-09"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each supplier and ship day; prices follow from extended price, tax and discount.

    Lines are dealt by symbol once, before they become bars: what runs along a symbol needs no other exchange. All columns are read wherever bars are, so
    the branches of a query (days, weeks, events) have the same exchange, which Spark makes once.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("scode"), F.col("l_shipdate").cast("date").alias("trade_date"), *LINE_COLUMNS)
    price = 20 + F.col("l_extendedprice") / 10000
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    rows = lines.repartition("scode").select("*", price.alias("p"), order.alias("k"))
    bars = rows.groupBy("scode", "trade_date").agg(
        F.min_by(F.col("p") * (1 + (F.col("l_tax") - F.col("l_discount")) / 2), "k").alias("open"),
        F.max_by("p", "k").alias("close"),
        F.max(F.col("p") * (1 + F.col("l_tax"))).alias("high"),
        F.min(F.col("p") * (1 - F.col("l_discount"))).alias("low"),
        F.sum("l_quantity").alias("volume"),
        # cents are summed as integers, so the order of the rows makes no difference
        (F.sum("l_quantity") * 20 / 10000 + F.sum(F.round(F.col("l_quantity") * F.col("l_extendedprice") * 100).cast("long")).cast("double") / 1e10).alias("amount"),
    )
    return bars.where(F.xxhash64("open", "close", "high", "low", "volume", "amount") >= LEAST_HASH)


#: What a bar is made of.
LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Every hash is this or more: a test that always holds and reads all columns.
LEAST_HASH = -(1 << 63)

BARS_SQL = """bars AS (
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS scode, CAST(l_shipdate AS DATE) AS trade_date,
           arg_min(p * (1 + (l_tax - l_discount) / 2), k) AS open, arg_max(p, k) AS close,
           max(p * (1 + l_tax)) AS high, min(p * (1 - l_discount)) AS low,
           sum(l_quantity) AS volume, sum(l_quantity) * 20 / 10000 + CAST(sum(CAST(round(l_quantity * l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e10 AS amount
    FROM (SELECT *, 20 + l_extendedprice / 10000 AS p, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS k FROM lineitem) x
    GROUP BY 1, 2)"""


def name_prefix(key):
    return F.when(key % 7 == 3, "*ST ").when(key % 11 == 5, "退市").otherwise("")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scode, sname and nation of each supplier; every seventh is specially treated, every eleventh delisted."""
    key = F.col("s_suppkey")
    prefix = name_prefix(key)
    return table(spark, sf_dir, "supplier").select(F.lpad(key.cast("string"), 6, "0").alias("scode"), F.concat(prefix, "s_name").alias("sname"), F.col("s_nationkey").alias("nation"))


STOCKS_SQL = """stocks AS (
    SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS scode,
           (CASE WHEN s_suppkey % 7 = 3 THEN '*ST ' WHEN s_suppkey % 11 = 5 THEN '退市' ELSE '' END) || s_name AS sname, s_nationkey AS nation
    FROM supplier)"""

#: Concepts of the demonstration news: words of the invented prose.
CONCEPTS = {"articles": ("the", "der", "les"), "joints": ("and", "und", "et"), "places": ("from", "von", "de"), "beings": ("is", "ist", "est")}


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: link, title (the first 60 characters), summary (all that follows), source, time, credibility, heat."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string")).alias("news_link"), F.substring("text", 1, 60).alias("title"), F.expr("substring(text, 61)").alias("summary"),
        F.col("source").alias("source_name"), F.expr("make_timestamp_ntz(2001, 1, 1, 9, 0, 0) + make_dt_interval(cast(doc_id % 60 as int))").alias("publish_time"),
        F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 6).otherwise(5).alias("credibility_level"), F.col("n_chars").alias("heat"), F.col("doc_id"))


NEWS_SQL = """news AS (
    SELECT 'https://news.example.com/' || CAST(d.doc_id AS VARCHAR) AS news_link, substring(text, 1, 60) AS title, substring(text, 61) AS summary,
           source AS source_name, TIMESTAMP '2001-01-01 09:00:00' + to_days(CAST(d.doc_id % 60 AS INTEGER)) AS publish_time,
           CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 6 ELSE 5 END AS credibility_level, n_chars AS heat, d.doc_id
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

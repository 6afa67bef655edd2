"""Raw inputs as rows: CSV bars, vendor bar lists, plans of distribution, feeds, page links, chat lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.scalars import clean_text, joined_hash, joined_url, lenient_date, normalize_symbol, null_safe_sum, number_before, unescaped
from tidebar.operators.bars import moving_averages

#: Names that a CSV may have for each column.
ALIASES = {
    "scode": ("scode", "symbol", "code", "ts_code", "代码", "股票代码"), "trade_date": ("trade_date", "date", "日期", "交易日期"), "open": ("open", "开盘", "开盘价"),
    "close": ("close", "收盘", "收盘价"), "high": ("high", "最高", "最高价"), "low": ("low", "最低", "最低价"), "volume": ("volume", "vol", "成交量"), "amount": ("amount", "成交额"),
}
REQUIRED = ("trade_date", "open", "close", "high", "low", "volume")


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of CSV files with any of the known headers, and their moving averages; the symbol comes from its column or the file's name.

    Of rows that repeat a symbol's day the last one stays: that of the greatest file name, and in a file the one furthest down.
    """
    raw = spark.read.option("header", "true").csv(path)
    known = {c.strip().lower(): c for c in raw.columns}
    found = {name: next((known[a] for a in names if a in known), None) for name, names in ALIASES.items()}
    if missing := [n for n in REQUIRED if found[n] is None]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    symbol = F.col(f"`{found['scode']}`") if found["scode"] else file
    numbers = [(F.col(f"`{found[c]}`").try_cast("double") if found[c] else F.lit(None).cast("double")).alias(c) for c in ("open", "close", "high", "low", "volume", "amount")]
    day = F.regexp_replace(F.substring(F.trim(F.col(f"`{found['trade_date']}`")), 1, 10), "/", "-")
    # numbers of a task's rows rise along a file's block, and blocks are told apart by where they start
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select(normalize_symbol(symbol).alias("scode"), lenient_date(day).alias("trade_date"), *numbers, place.alias("__place")).where("trade_date IS NOT NULL")
    last = rows.groupBy("scode", "trade_date").agg(F.max_by(F.struct(*[c for c in rows.columns[2:-1]]), "__place").alias("r")).select("scode", "trade_date", "r.*")
    return moving_averages(last)


def vendor_bars(payloads: DataFrame, symbol: str, payload: str = "payload") -> DataFrame:
    """Bars of JSON(P) payloads: data.<symbol>.qfqday, or day where that is missing; lists of date, open, close, high, low, volume, ..., amount (9th, in
    10,000); lists with fewer than 6 cells go."""
    text = F.regexp_replace(payload, r"^\s*[\w$.]+\s*=\s*", "")
    cells = F.coalesce(F.get_json_object(text, f"$.data.{symbol}.qfqday"), F.get_json_object(text, f"$.data.{symbol}.day"))
    rows = payloads.select(F.explode(F.from_json(cells, "array<array<string>>")).alias("r")).where(F.size("r") >= 6)

    def number(i: int) -> Column:
        return F.get(F.col("r"), F.lit(i)).try_cast("double")

    return rows.select(F.lit(symbol).alias("scode"), F.to_date(F.col("r")[0]).alias("trade_date"), number(1).alias("open"), number(2).alias("close"), number(3).alias("high"), number(4).alias("low"), number(5).alias("volume"), number(8).alias("amount"))


def distribution_plans(records: DataFrame) -> DataFrame:
    """Plans (security_code, nd, fh_sh, djr, cqr, FHcontent): report day, ratios, and hashes of key and content."""
    bonus, transfer, cash = (number_before(F.col("FHcontent"), v) for v in ("送", "转", "派"))
    rows = records.select(
        normalize_symbol(F.col("security_code")).alias("scode"), F.make_date(F.col("nd").try_cast("int"), F.lit(12), F.lit(31)).alias("report_date"), lenient_date(F.col("djr")).alias("record_date"),
        lenient_date(F.col("cqr")).alias("ex_date"), bonus.alias("bonus"), transfer.alias("transfer"), null_safe_sum(bonus, transfer).alias("bonus_total"), F.coalesce(cash, F.col("fh_sh").try_cast("double")).alias("cash"), F.col("FHcontent").alias("plan"))
    keyed = rows.withColumn("source_key", joined_hash(F.col("scode"), F.col("report_date"), F.col("ex_date")))
    return keyed.withColumn("content_hash", joined_hash(*[F.col(c) for c in rows.columns]))


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS texts: title, link, description, date; items without a link go."""
    items = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item[ >](.*?)</item>"), F.lit(1))).alias("item"))

    def part(*names: str) -> Column:
        inner = [F.nullif(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), F.lit("")) for n in names]
        return F.coalesce(*inner, F.lit(""))

    return items.select(clean_text(part("title")).alias("title"), F.trim(part("link")).alias("news_link"), clean_text(part("description")).alias("summary"), F.trim(part("pubDate", "date")).alias("publish_time")).where("news_link <> ''")


def page_links(pages: DataFrame, least_title: int = 8, most: int = 300, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Links of pages in order (n from 1): titles of `least_title` characters (512 are kept, the summary has all), web addresses without fragment only,
    each once; the first `most` of a page (a feature of link lists)."""
    # what follows each opening tag of an anchor, up to the next one
    after = F.slice(F.split(F.col(html), r"(?i)<a(?=\s)"), 2, 1 << 30)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("base"), F.posexplode(after).alias("place", "part"))
    tag, body = F.regexp_extract("part", r"^([^>]*)>", 1), F.regexp_extract("part", r"(?is)^[^>]*>(.*?)</a\s*>", 1)
    quoted = [F.nullif(F.regexp_extract(tag, rf"(?i)\bhref\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")]
    rows = rows.select("page_id", "base", "place", F.trim(unescaped(F.coalesce(*quoted))).alias("href"), clean_text(body).alias("summary"))
    rows = rows.where((F.char_length("summary") >= least_title) & ~F.contains("href", F.lit("#")) & ~F.lower("href").rlike("^(javascript|mailto):"))
    links = rows.select("page_id", "place", "summary", joined_url(F.coalesce("base", F.lit("")), F.col("href")).alias("link")).where(F.col("link").rlike("^https?://"))
    first = links.groupBy("page_id", "link").agg(F.min_by("summary", "place").alias("summary"), F.min("place").alias("place"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("n") <= most)
    return numbered.select("page_id", "n", F.left("summary", F.lit(512)).alias("title"), "summary", "link")


def chat_samples(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as one array of messages each, in order."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))

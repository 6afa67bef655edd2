"""Scalar functions as Column builders: symbols, dates, ratios, hashes, encodings.

Nulls give nulls unless a line says otherwise. Amounts are computed in doubles; only sinks cast to decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop-loss series.
STOP_LOSSES = (0.03, 0.035, 0.04, 0.045, 0.05, 0.055, 0.06)

def normalize_symbol(c: Column) -> Column:
    """The last six digits, filled up with zeros."""
    return F.lpad(F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(6)), 6, "0")


def exchange_of(c: Column) -> Column:
    return F.when(c.rlike("^[489]"), "bj").when(c.rlike("^[56]"), "sh").otherwise("sz")


def lenient_date(c: Column) -> Column:
    """YYYYMMDD with or without hyphens; anything else is null."""
    digits = F.regexp_replace(F.trim(c), "-", "")
    return F.when(digits.rlike("^[0-9]{8}$"), F.try_to_date(digits, "yyyyMMdd"))


def bounded_start(c: Column, least: str = "20100101") -> Column:
    return F.greatest(c, F.lit(least))


def number_before(c: Column, verb: str) -> Column:
    """The ratio x of a plan such as 10<verb>x; null where the plan has none."""
    return F.regexp_extract(c, rf"10{verb}([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def null_safe_sum(*columns: Column) -> Column:
    """Sum of those that are not null; null where all are."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def joined_hash(*columns: Column) -> Column:
    """SHA-256 of the fields joined by bars, nulls as nothing."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def stable_rank(seed: int, *parts: Column) -> Column:
    """Sixteen hexadecimal digits that order rows at random, but always alike."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, 16)


def parse_heat(c: Column) -> Column:
    """1.5万 is 15000, 2,300 is 2300; what is no number is 0."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), ",", "")
    unit = F.when(text.endswith("亿"), 1e8).when(text.endswith("万"), 1e4).otherwise(1.0)
    number = F.regexp_replace(text, "[万亿]$", "").try_cast("double")
    return F.coalesce((number * unit).cast("bigint"), F.lit(0))


def unescaped(c: Column) -> Column:
    """Common character references decoded."""
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def clean_text(c: Column) -> Column:
    """Without tags, common character references decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, "(?s)<[^>]*>", " ")), r"\s+", " "))


def joined_url(base: Column, href: Column) -> Column:
    """The address that a link means on a page: whole addresses as they are, others from the page's scheme, host or folder; . and .. are resolved."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.substr(page, F.length(host) + 1), r"^(.*/)", 1)
    path = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    tail = F.regexp_extract(path, r"(\?.*)$", 1)
    steps = F.split(F.regexp_extract(path, r"^([^?]*)", 1), "/")

    def walk(done: Column, step: Column) -> Column:
        return F.when(step == ".", done).when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(step)))

    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"), ends, tail)
    dotted = F.when(path.rlike(r"/\.\.?(/|\?|$)"), resolved).otherwise(path)
    return F.when(href.rlike(r"^[A-Za-z][\w+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("?"), F.concat(page, href)).otherwise(F.concat(host, dotted))


def publish_time(c: Column) -> Column:
    """RFC 2822, ISO or plain time stamps; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|[+-]\d{4})$", "")
    tries = [F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")]
    return F.coalesce(*tries).cast("timestamp_ntz")


def occurrences(text: Column, word: str) -> Column:
    """Occurrences that don't overlap."""
    text = F.coalesce(text, F.lit(""))
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def json_strings(c: Column) -> Column:
    """A JSON list of strings; what is none gives an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_heats(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<struct<concept:string,heat:double>>"), F.array().cast("array<struct<concept:string,heat:double>>"))


def growth(now: Column, before: Column) -> Column:
    """now / before - 1 where before is positive, else null."""
    return F.when(before > 0, now / before - 1)


def round_cent(c: Column) -> Column:
    """Half up to 0.01 of the decimal text, as money is rounded."""
    return F.round(c.cast("string").cast("decimal(38,10)"), 2).cast("double")


def lot_shares(budget: float, price: Column) -> Column:
    """Shares in lots of 100 for a budget, halves to the even lot."""
    return F.when(price > 0, (F.bround(F.lit(budget) / price / 100, 0) * 100).cast("long")).otherwise(F.lit(0).cast("long"))


def weighted_price(amount: Column, volume: Column, low: Column, high: Column, anchor: Column, typical: Column) -> Column:
    """Price from amount and volume whose units are not known: amount x 100 or x 10000 over volume, whichever lies within
    [0.8 low, 1.2 high] and is nearer the anchor; the typical price if neither does."""
    lowest, highest = F.when(low > 0, 0.8 * low).otherwise(F.lit(0.0)), F.when(high > 0, 1.2 * high).otherwise(F.lit(float("inf")))
    one, two = F.when(volume > 0, amount * 100 / volume), F.when(volume > 0, amount * 10000 / volume)
    fits = [F.coalesce((x > 0) & (x >= lowest) & (x <= highest), F.lit(False)) for x in (one, two)]
    nearer = F.abs(one - anchor) <= F.abs(two - anchor)
    return F.when(fits[0] & (~fits[1] | nearer), one).when(fits[1], two).otherwise(typical)


def bar_price() -> Column:
    """Weighted price of a single bar, in cents; columns amount, volume, low, high, close."""
    middle = F.when(F.col("close") > 0, F.col("close")).otherwise((F.col("high") + F.col("low")) / 2)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return round_cent(weighted_price(F.col("amount"), F.col("volume"), F.col("low"), F.col("high"), middle, typical))


def rule_name(loss: float) -> str:
    """The name of a stop-loss rule of the series."""
    if not any(abs(loss - x) < 1e-12 for x in STOP_LOSSES):
        raise ValueError(f"unknown stop loss {loss}")
    return f"stop_loss_{loss * 100:g}pct_take_profit_10_20_hold_3d"


def rule_loss(c: Column) -> Column:
    """The loss that a rule's name gives, null for names that are not of the series."""
    loss = F.regexp_extract(c, r"^stop_loss_([0-9.]+)pct_", 1).try_cast("double") / 100
    known = F.exists(F.array(*map(F.lit, STOP_LOSSES)), lambda x: F.abs(x - loss) < 1e-12)
    return F.when(known, loss)


def percent_or_share(c: Column) -> Column:
    return F.when(c > 1, c / 100).otherwise(c)


def failure_rate(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rate))


def two_decimals(c: Column) -> Column:
    """The number's exact value to two decimals, halves to even, as printf has it."""
    return F.call_function("format_number", c.cast("double"), F.lit("0.00"))


def ratio_text(value: Column, denominator: Column) -> Column:
    """Two decimals without zeros at the end; 0 where the denominator is not positive."""
    text = two_decimals(F.coalesce(value, F.lit(0.0)) / denominator)
    return F.when(F.coalesce(denominator > 0, F.lit(False)), F.regexp_replace(text, r"\.?0+$", "")).otherwise("0")


def positive_average(values: Column) -> Column:
    """Average of the positive members of an array; 0 without any."""
    good = F.filter(values, lambda v: v > 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, v: a + v) / F.size(good)).otherwise(F.lit(0.0))


def is_special_name(c: Column) -> Column:
    """ST or PT anywhere in the name, white space left out."""
    name = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return name.contains("ST") | name.contains("PT")


def is_delisted_name(c: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return name.contains("退市") | name.startswith("退") | name.startswith("PT") | name.endswith("退")


def class_probabilities(losses: dict[str, Column]) -> dict[str, Column]:
    """Shares of exp(-loss)."""
    parts = {k: F.exp(-v) for k, v in losses.items()}
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    return {k: p / total for k, p in parts.items()}


def selection_score(positive: Column, negative: Column, neutral: Column, negative_weight: float = 0.5, neutral_weight: float = 0.0) -> Column:
    return positive - negative_weight * negative - neutral_weight * neutral


def message_driven(title: Column, summary: Column, name: Column, code: Column, keywords: list[str]) -> Column:
    """The text names the stock by name or code, and has a keyword."""
    text = F.concat_ws(" ", title, summary)
    named = F.coalesce((F.length(name) > 0) & F.contains(text, name), F.lit(False)) | F.coalesce(F.contains(text, code), F.lit(False))
    told = F.lit(False)
    for k in keywords:
        told = told | F.contains(text, F.lit(k))
    return named & told

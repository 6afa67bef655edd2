"""Texts of windows and labels for prompts: JSON payloads, basis points, answers; reading old payloads again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume", "amount")


def payload(bars: Column, fields: tuple[str, ...] = FIELDS, digits: int = 4) -> Column:
    """A window as JSON records with the day and numbers of four decimals (halves to even)."""
    return F.to_json(F.transform(bars, lambda b: F.struct(F.date_format(b["day"], "yyyy-MM-dd").alias("date"), *[F.bround(b[c], digits).alias(c) for c in fields])))


def basis_points(bars: Column) -> Column:
    """Rows of open, high, low and close in basis points of the last close, and volume in percent of the window's mean."""
    def rows(s: Column) -> Column:
        def row(b: Column) -> Column:
            prices = [F.bround((b[c] / s["last"] - 1) * 10000).cast("long") for c in ("open", "high", "low", "close")]
            return F.array(*prices, F.bround(b["volume"] / s["mean"] * 100).cast("long"))

        return F.transform(s["bars"], row)

    mean = F.aggregate(bars, F.lit(0.0), lambda a, b: a + b["volume"]) / F.size(bars)
    bound = F.struct(bars.alias("bars"), F.element_at(bars, -1)["close"].alias("last"), mean.alias("mean"))
    return F.transform(F.array(bound), rows)[0]


def answer(label: Column, kind: str = "class") -> Column:
    """The text that a model should give: {"c":"positive"}, or {"p":1} for a number."""
    if kind == "class":
        return F.concat(F.lit('{"c":"'), label, F.lit('"}'))
    return F.concat(F.lit('{"p":'), label.cast("string"), F.lit("}"))


def answered(text: Column) -> Column:
    """The class of an answer in any of its forms, null where it has none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(found, "c string, p int, label int")
    return F.coalesce(parsed["c"], F.when(F.coalesce(parsed["p"], parsed["label"]) == 1, "positive").when(F.coalesce(parsed["p"], parsed["label"]) == 0, "negative"))


def old_windows(text: Column) -> Column:
    """daily_55 and weekly_55 of an old JSON payload as arrays of bars."""
    bar = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,amount:double,ma5:double,ma13:double,ma34:double,ma55:double>>"
    return F.from_json(text, f"scode string, anchor_date string, daily_55 {bar}, weekly_55 {bar}")


def top_text(rows: Column, limit: int = 5) -> Column:
    """code:probability of the first `limit` of a sorted array of structs."""
    return F.array_join(F.transform(F.slice(rows, 1, limit), lambda r: F.concat(r["scode"], F.lit(":"), F.round(r["probability"], 4).cast("string"))), ", ")

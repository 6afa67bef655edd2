"""Labelled sample sets: splits, balances, cooldowns, windows of bars and their texts. Random orders are hash orders, so they repeat."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.functions.scalars import positive_average, ratio_text, stable_rank
from tidebar.sources.scratch import released, stored

from .bars import along, ordinals

#: Daily, weekly and monthly bars of a sample.
MODES = {"short": (8, 5, 0), "long": (13, 8, 5), "xlong": (21, 13, 8), "xxlong": (34, 21, 13)}
#: Negatives and neutrals for each positive.
NEGATIVES, NEUTRALS = 4, 11
COLUMNS = ("open", "high", "low", "close", "volume", "amount", "ma5", "ma13", "ma34", "ma55")
RATIOS = {"positive": 1, "negative": NEGATIVES, "neutral": NEUTRALS}


def cooldown(events: DataFrame, gap: int = 20, index: str = "trade_index", key: str = "scode") -> DataFrame:
    """Of each symbol's events those more than `gap` positions after the last one that was kept.

    A greedy fold over the symbol's event positions (an array of integers, not of rows).
    """
    step = F.aggregate(
        F.array_sort(F.collect_set(index)), F.array().cast(f"array<{events.schema[index].dataType.simpleString()}>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.concat(kept, F.array(x))).otherwise(kept))
    kept = events.groupBy(key).agg(step.alias("k")).select(key, F.explode("k").alias(index))
    return events.join(kept, [key, index], "left_semi")


def event_cooldown(events: DataFrame, bars: DataFrame, gap: int = 20) -> DataFrame:
    """Events (scode, anchor_date) that are more than `gap` trading days after the symbol's last one that was kept.

    An event on a day without a bar of its symbol is compared by calendar days with the last one kept, and once it is kept, the next event with a bar is kept too.
    Events that repeat count once. A symbol's events, one for a day at most, are walked in one pass.
    """
    if gap <= 0:
        return events
    days = bars.select("scode", F.col("trade_date").alias("anchor_date"), (F.row_number().over(along()) - 1).alias("__index"))
    dated = events.select("scode", "anchor_date").distinct().join(days, ["scode", "anchor_date"], "left")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        kept, last_index, last_day = [], None, None
        ordered = frame.sort_values("anchor_date")
        for day, index in zip(ordered["anchor_date"], ordered["__index"]):
            if pd.isna(index):
                if last_day is not None and (day - last_day).days <= gap:
                    continue
                last_index = None
            else:
                if last_index is not None and index - last_index <= gap:
                    continue
                last_index = index
            last_day = day
            kept.append(day)
        return pd.DataFrame({"scode": [frame["scode"].iloc[0]] * len(kept), "anchor_date": kept})

    kept = dated.groupBy("scode").applyInPandas(walk, "scode string, anchor_date date")
    return events.join(kept, ["scode", "anchor_date"], "left_semi")


def write_split(rows: DataFrame, path: str, seed: int, keys: list[str], share: float = 0.2, settings: Mapping[str, object] | None = None) -> dict:
    """Split rows by hash, write train and eval as lines of JSON, and a manifest of counts by label, seed, share and settings beside them; the manifest is returned.

    The rows are stored once, so both parts come from the same ones.
    """
    from tidebar.sources import store

    split = stored(hash_split(rows, seed, keys, share), "split")
    for name, part in (("train", split.where(~F.col("is_eval"))), ("eval", split.where("is_eval"))):
        store.write_jsonl(part.drop("is_eval"), f"{path}/{name}")
    label = F.col("label").cast("string") if "label" in rows.columns else F.lit("all")
    counts = split.groupBy(label.alias("label"), "is_eval").count().collect()  # a row for each label and part
    told = {"seed": seed, "share": share, "keys": keys, **(settings or {})}
    for name, flag in (("train", False), ("eval", True)):
        told[name] = {"path": f"{path}/{name}", "rows": sum(r["count"] for r in counts if r.is_eval == flag), "labels": {str(r.label): r["count"] for r in sorted(counts, key=lambda r: str(r.label)) if r.is_eval == flag}}
    released(split)
    text = json.dumps(told, ensure_ascii=False, sort_keys=True, default=str)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return told


#: Rows that one task may sort where a hash order is cut.
SORTED_ROWS = 100_000


def _cut(ranked: DataFrame, n: int, rank: str) -> tuple[str, int] | None:
    """Where the first n rows by a hash rank end: a beginning of ranks, and how many of the rows that begin so are among them. None where there are n rows at most.

    Rows are counted by three digits of the rank at a time (4,096 counts), and again only those of the beginning where n is reached, until it has few.
    """
    start, left = "", n
    while True:
        head = F.substring(rank, 1, len(start) + 3)
        counts = ranked.where(F.col(rank).startswith(start)).groupBy(head.alias("head")).count().orderBy("head").collect()
        for head, count in counts:
            if left <= count:
                break
            left -= count
        else:
            return None
        whole, start = len(head) < len(start) + 3, head
        if count <= SORTED_ROWS or whole:  # few rows, or rows of one rank
            return start, left


def lowest(ranked: DataFrame, n: int, rank: str = "hash_rank", ties: Sequence[str] = ("scode", "trade_date")) -> DataFrame:
    """The n rows with the lowest hash rank (hexadecimal digits), ties by columns: a filter, and a sort of the few rows around the end alone.

    `ranked` is read once more for each three digits that are needed, one time up to some 400 million rows.
    """
    if n <= 0:
        return ranked.where("false")
    found = _cut(ranked, n, rank)
    if found is None:
        return ranked
    start, left = found
    return ranked.where(F.col(rank) < start).unionByName(ranked.where(F.col(rank).startswith(start)).orderBy(rank, *ties).limit(left))


def hash_split(rows: DataFrame, seed: int, keys: list[str], share: float = 0.2) -> DataFrame:
    """rows with is_eval: the lowest hash ranks, max(1, round-half-even(share n)) of them; none of a single row."""
    rank = stable_rank(seed, *[F.col(k) for k in keys])
    n = rows.count()
    wanted = max(1, round(share * n)) if n > 1 else 0
    ranked = rows.select(rank.alias("r"), *keys)
    start, left = (_cut(ranked, wanted, "r") if wanted else None) or ("", wanted)
    edge = ranked.where(F.col("r").startswith(start)).orderBy("r", *keys).limit(left).select(F.struct("r", *keys).alias("x")).agg(F.max("x").alias("edge"))
    return rows.crossJoin(F.broadcast(edge)).withColumn("is_eval", F.coalesce(F.struct(rank.alias("r"), *keys) <= F.col("edge"), F.lit(False))).drop("edge")


def negatives(bars: DataFrame, positives: DataFrame, seed: int, limit: int, scan_limit: int | None = None) -> DataFrame:
    """Bars that are no positives, the `limit` lowest by hash; scan_limit first takes that many by symbol and day, as a biased but cheap scan does."""
    others = bars.join(positives.select("scode", "trade_date"), ["scode", "trade_date"], "left_anti").select("scode", "trade_date")
    if scan_limit:
        others = others.orderBy("scode", "trade_date").limit(scan_limit)
    return lowest(others.withColumn("hash_rank", stable_rank(seed, F.col("scode"), F.col("trade_date"))), limit)


def _ranked(rows: DataFrame, seed: int, tag: str, by: list[str]) -> DataFrame:
    rank = stable_rank(seed, F.lit(tag), F.col("scode"), F.col("trade_date"))
    return rows.withColumn("hash_rank", rank).withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("hash_rank", "scode", "trade_date")))


def rebalance_same_date(rows: DataFrame, seed: int = 7) -> DataFrame:
    """Of each day, as many cycles of 1 positive, 4 negatives and 11 neutrals as it has; rows keep their cycle, counted in each day from 1."""
    ranked = _ranked(rows.where(F.col("label").isin(list(RATIOS))), seed, "rebalance", ["trade_date", "label"])
    counts = rows.groupBy("trade_date").agg(*[F.count(F.when(F.col("label") == k, 1)).alias(k) for k in RATIOS])
    cycles = counts.select("trade_date", F.least(*[F.floor(F.col(k) / n) for k, n in RATIOS.items()]).alias("cycles")).where("cycles > 0")
    size = F.when(F.col("label") == "negative", NEGATIVES).when(F.col("label") == "neutral", NEUTRALS).otherwise(1)
    placed = ranked.join(cycles, "trade_date").withColumn("cycle", F.ceil(F.col("n") / size))
    return placed.where("cycle <= cycles").select("scode", "trade_date", "label", "cycle", "hash_rank")


def interleave(rows: DataFrame, seed: int = 7) -> DataFrame:
    """Whole cycles in order: days by their hash, then cycles, then members by their hash; rows of incomplete cycles go. `place` counts all from 1 within each day."""
    balanced = rebalance_same_date(rows, seed)
    day = stable_rank(seed, F.lit("date"), F.col("trade_date"))
    w = Window.partitionBy("trade_date").orderBy("cycle", "hash_rank", "scode")
    return balanced.withColumn("date_rank", day).withColumn("place", F.row_number().over(w))


def evaluation_set(rows: DataFrame, seed: int = 7, positive_limit: int | None = None) -> DataFrame:
    """The ratio kept over all days: the lowest hash ranks of each class."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    cycles = min(counts.get(k, 0) // n for k, n in RATIOS.items())
    cycles = min(cycles, positive_limit) if positive_limit else cycles
    if not cycles:
        raise ValueError("a class has too few rows")
    parts = []
    for k, n in RATIOS.items():
        rank = stable_rank(seed, F.lit("evaluation"), F.col("scode"), F.col("trade_date"))
        parts.append(lowest(rows.where(F.col("label") == k).withColumn("hash_rank", rank), cycles * n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_split(rows: DataFrame, share: float, seed: int = 7, by: str = "label") -> DataFrame:
    """rows with is_train: of each class the lowest hash ranks, round-half-even(share n).

    Rows are counted by class and the first digits of their hash, so that no task ranks a whole class; only a count for each class reaches the driver.
    """
    name = F.concat(F.coalesce(F.col(by).cast("string"), F.lit("")), F.lit("|"))
    marked = rows.withColumn("hash_rank", stable_rank(seed, F.lit("split"), F.col("scode"), F.col("trade_date")))
    before, bounds = 0, []
    for label, n in sorted(tuple(r) for r in marked.groupBy(name.alias("label")).count().collect()):
        bounds += [F.lit(label), F.lit(before + round(share * n))]
        before += n
    if not bounds:
        return marked.withColumn("is_train", F.lit(False))
    placed = ordinals(marked, F.concat(name, F.substring("hash_rank", 1, 3)), [F.col("hash_rank"), F.col("scode"), F.col("trade_date")], "__n")
    return placed.withColumn("is_train", F.col("__n") < F.create_map(*bounds)[name]).drop("__n")


def window_arrays(anchors: DataFrame, bars: DataFrame, size: int, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Anchors (scode, trade_date and any more columns) with the last `size` bars at or before them, as an array `bars`; null where there are fewer.

    Anchors stand among the bars of their symbol, and a window over the bars' places gathers those before each. Arrays exist for anchors alone, and none is shuffled.
    """
    kept = [c for c in anchors.columns if c not in ("scode", "trade_date")]
    fields = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns]
    own = bars.select("scode", "trade_date", F.lit(0).alias("__side"), F.struct(F.lit(0).alias("place"), F.col("trade_date").alias("day"), *fields).alias("bar"), *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in kept])
    at = anchors.select("scode", "trade_date", F.lit(1).alias("__side"), F.lit(None).cast(own.schema["bar"].dataType).alias("bar"), *kept)
    order = Window.partitionBy("scode").orderBy("trade_date", "__side").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.union(at).withColumn("place", F.count("bar").over(order))
    # anchors that no bar precedes have the place 0; each bar stands for its place
    near = Window.partitionBy("scode").orderBy("place").rangeBetween(1 - size, 0)
    found = placed.withColumn("bars", F.collect_list(F.col("bar").withField("place", F.col("place"))).over(near)).where("__side = 1")
    return found.select("scode", "trade_date", *kept, F.when(F.size("bars") == size, F.sort_array("bars")).alias("bars"))


def compact_text(bars: Column, columns: tuple[str, ...] = COLUMNS) -> Column:
    """Lines of an index and ratios: prices and averages to the mean close, volume and amount to their own means.

    The means are bound once by an array of one struct; else every line would compute them again.
    """
    own = [c for c in ("close", "volume", "amount") if c == "close" or c in columns]

    def mean(name: str) -> Column:
        return positive_average(F.transform(bars, lambda b: b[name]))

    def lines(s: Column) -> Column:
        def line(b: Column, i: Column) -> Column:
            return F.concat_ws(",", (i + 1).cast("string"), *[ratio_text(b[c], s[c if c in own else "close"]) for c in columns])

        return F.array_join(F.transform(s["bars"], line), "\n")

    return F.transform(F.array(F.struct(bars.alias("bars"), *[mean(c).alias(c) for c in own])), lines)[0]


def samples(events: DataFrame, daily: DataFrame, weekly: DataFrame, monthly: DataFrame, mode: str = "long") -> DataFrame:
    """Events (scode, trade_date, label) as messages and metadata, where all windows are full. Bars have their averages."""
    d, w, m = MODES[mode]
    out = events.select("scode", "trade_date", "label")
    parts = [F.concat(F.lit("s="), F.col("scode")), F.lit(f"mode={mode}"), F.lit("cols=i," + ",".join(COLUMNS))]
    for name, bars, size in (("D", daily, d), ("W", weekly, w), ("M", monthly, m)):
        if size:
            # each window's text is carried to the next as a column, so that nothing is joined
            out = window_arrays(out, bars, size).where("bars IS NOT NULL").withColumn(f"text_{name}", compact_text(F.col("bars"))).drop("bars")
            parts += [F.lit(name), F.col(f"text_{name}")]
    messages = F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n", *parts).alias("content")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit('{"c":"'), F.col("label"), F.lit('"}')).alias("content")))
    metadata = F.struct("scode", F.col("trade_date").cast("string").alias("anchor_date"), "label", F.lit(mode).alias("sample_mode"))
    return out.select("scode", "trade_date", messages.alias("messages"), metadata.alias("metadata"))


def in_bottom_band(close: Column, low: Column, high: Column, ratio: float = 0.10) -> Column:
    """The close lies in the lowest share of the window's range."""
    ratio = min(max(ratio, 0.0), 1.0)
    good = (close > 0) & (low > 0) & (high > 0)
    return F.coalesce(good & F.when(high <= low, close <= low).otherwise(close <= low + (high - low) * ratio), F.lit(False))


def balanced_rows(rows: DataFrame, ratio: int, seed: int = 7, target: str = "down6", other: str = "neutral") -> DataFrame:
    """All rows of the target class for which there are `ratio` others, and those others, each the lowest by hash; `rank_no` orders both classes together."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    kept = min(counts.get(target, 0), counts.get(other, 0) // ratio)
    rank = stable_rank(seed, F.lit("balance"), F.col("scode"), F.col("trade_date"))
    parts = [lowest(rows.where(F.col("label") == k).withColumn("hash_rank", rank), n) for k, n in ((target, kept), (other, kept * ratio))]
    both = parts[0].unionByName(parts[1])
    # counted by the first digits of the hash, which follow its order
    return ordinals(both, F.substring("hash_rank", 1, 3), [F.col("hash_rank"), F.col("scode"), F.col("trade_date")], "rank_no").withColumn("rank_no", F.col("rank_no") + 1)


def until_target(ranked: DataFrame, made: DataFrame, target: dict[str, int], order: str = "hash_rank") -> DataFrame:
    """Of each class the first `target` ranked events whose sample could be made (a row in `made`): what a loop that stops early keeps."""
    usable = ranked.join(made, ["scode", "trade_date"])
    parts = [usable.where(F.col("label") == k).orderBy(order, "scode", "trade_date").limit(n) for k, n in target.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replacement_pool(candidates: DataFrame, excluded: DataFrame, wanted: int, seed: int = 7, attempts: int = 20, path: str | None = None) -> DataFrame:
    """`wanted` rows of candidates whose key is not excluded, by hash; an attempt doubles how many are looked at, so a pool with many exclusions costs
    no more passes than the logarithm. With a path the pool is stored there, and found again by the next call.

    Raises ValueError when all candidates, or `attempts` doublings, do not suffice.
    """
    from tidebar.sources.store import exists

    key = ["scode", "trade_date"]
    spark = candidates.sparkSession
    if path and exists(spark, path):
        return spark.read.parquet(path)
    ranked = candidates.withColumn("hash_rank", stable_rank(seed, F.lit("pool"), *[F.col(k) for k in key])).dropDuplicates(key)
    looked, total = wanted, ranked.count()
    for _ in range(attempts):
        free = ranked.orderBy("hash_rank", *key).limit(min(looked, total)).join(excluded.select(key).distinct(), key, "left_anti")
        if free.count() >= wanted:
            out = free.orderBy("hash_rank", *key).limit(wanted)
            if path:
                out.write.parquet(path)
                return spark.read.parquet(path)
            return out
        if looked >= total:
            break
        looked *= 2
    raise ValueError("the pool has too few rows")


def dataset_settings(samples: DataFrame) -> DataFrame:
    """What a written data set was made with: its mode, the first and last anchor, rows and labels. `samples` have metadata as samples() makes it."""
    m = F.col("metadata")
    return samples.agg(F.min(m["sample_mode"]).alias("mode"), F.count_distinct(m["sample_mode"]).alias("modes"), F.min(m["anchor_date"]).alias("first_anchor"), F.max(m["anchor_date"]).alias("last_anchor"), F.count("*").alias("samples"), F.count_distinct(m["label"]).alias("labels"))


def hard_negative_counts(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Counts by kind, halves to even; the last kind takes what is left."""
    kinds = list(shares)
    out = {k: round(total * shares[k]) for k in kinds[:-1]}
    return out | {kinds[-1]: total - sum(out.values())}


def reshuffle(scored: DataFrame, pool: DataFrame, excluded: DataFrame, keep: dict[str, int], total: dict[str, int], seed: int = 7) -> DataFrame:
    """Of each kind the top-scored negatives, filled up to the total from the pool by hash; keys that are excluded or kept are not drawn again.

    Raises ValueError where the pool has too few rows.
    """
    key = ["scode", "trade_date"]
    parts = []
    for kind, n in total.items():
        best = by_score(scored.where(F.col("kind") == kind))
        top = best.where(F.col("n") <= min(keep.get(kind, 0), n)).select(*key, "kind")
        missing = n - top.count()
        parts.append(top)
        if missing > 0:
            free = pool.where(F.col("kind") == kind).join(excluded.select(key), key, "left_anti").join(top.select(key), key, "left_anti").dropDuplicates(key)
            drawn = lowest(free.withColumn("r", stable_rank(seed, F.lit("refill"), *[F.col(k) for k in key])), missing, "r").select(*key, "kind")
            if drawn.count() < missing:
                raise ValueError(f"the pool has too few rows of {kind}")
            parts.append(drawn)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_score(scored: DataFrame) -> DataFrame:
    """Rows with their place `n` from 1, highest score first, unscored last, ties by symbol and day; counted by rounded score."""
    coarse = F.coalesce(-F.floor(F.col("score") * 10_000), F.lit(1 << 60))
    return ordinals(scored, coarse, [F.desc_nulls_last("score"), F.col("scode"), F.col("trade_date")]).withColumn("n", F.col("n") + 1)


def positive_reshuffle(scored: DataFrame, seed: int = 7, top_share: float = 0.3, kept_share: float = 0.1, negatives_each: float = 4) -> DataFrame:
    """Positives without most of the top-scored 30 percent, and negatives in ratio, by hash.

    The top has the share rounded up, and of it a tenth rounded up, one at least, stays, by hash.
    """
    ones = by_score(scored.where("label = 1"))
    count = ones.count()
    edge = min(count, max(0, math.ceil(count * top_share)))
    kept = min(edge, max(min(edge, 1), math.ceil(edge * kept_share)))
    rank = stable_rank(seed, F.lit("top"), F.col("scode"), F.col("trade_date"))
    stay = lowest(ones.where(F.col("n") <= edge).withColumn("r", rank), kept, "r").drop("r")
    tail = ones.where(F.col("n") > edge)
    zeros = lowest(scored.where("label = 0").withColumn("r", rank), round((count - edge + kept) * negatives_each), "r").drop("r")
    return stay.drop("n").unionByName(tail.drop("n")).unionByName(zeros)


def labelled_stream(bars: DataFrame, start: str, end: str, gap: int = 20) -> DataFrame:
    """Three-class rows of a range in which positives keep their distance: those within `gap` rows of the last kept one are dropped, not relabelled.

    Positions count every row of the range, with or without a label.
    """
    from .labels import threeclass_labels

    inside = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    placed = bars.where(inside).select("scode", "trade_date", (F.row_number().over(along()) - 1).alias("trade_index"))
    rows = threeclass_labels(bars).where(inside & (F.col("label") != "discard")).join(placed, ["scode", "trade_date"]).select("scode", "trade_date", "trade_index", "label")
    kept = cooldown(rows.where("label = 'positive'"), gap)
    return rows.where("label <> 'positive'").unionByName(kept.select(rows.columns))


def valid_windows(daily: Column, weekly: Column, monthly: Column, mode: str) -> Column:
    """Whether a sample has all bars of its mode; the mode `short` wants the last five weekly averages (ma13) to be positive."""
    d, w, m = MODES[mode]
    good = (F.size(daily) >= d) & (F.size(weekly) >= w)
    if mode == "short":
        return good & F.forall(F.slice(weekly, -5, 5), lambda b: b["ma13"] > 0)
    return good & (F.size(monthly) >= m) if m else good


def eval_subset(rows: DataFrame, kind: str, n: int, keys: list[str], seed: int = 7) -> DataFrame:
    """A repeatable subset for evaluation: all, the first n by key, every k-th, or n by hash."""
    if kind == "all":
        return rows
    if kind == "fixed":
        return rows.orderBy(*keys).limit(n)
    if kind == "stride":
        step = max(1, rows.count() // n)
        return ordinals(rows, F.col(keys[0]), [F.col(k) for k in keys], "__n").where((F.col("__n") % step == 0) & (F.col("__n") / step < n)).drop("__n")
    if kind == "random":
        return rows.withColumn("__r", stable_rank(seed, *[F.col(k) for k in keys])).orderBy("__r", *keys).limit(n).drop("__r")
    raise ValueError("kind is all, fixed, stride or random")

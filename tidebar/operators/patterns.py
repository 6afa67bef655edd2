"""Patterns: combinations of feature tokens, their support among events, and how often they are right over all bars."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.sources.scratch import released, stored

from . import features as X
from . import itemsets
from .bars import ordinals

SEPARATOR = " && "


def combinations(tokens: Column, most: int) -> Column:
    """All sorted combinations of one to `most` (1 to 3) members of a sorted array, as an array of arrays."""
    n = F.size(tokens)

    def above(i: Column) -> Column:
        return F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))

    start = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = [F.transform(tokens, lambda t: F.array(t))]
    if most >= 2:
        parts.append(F.flatten(F.transform(start, lambda i: F.transform(above(i), lambda j: F.array(tokens[i], tokens[j])))))
    if most >= 3:
        parts.append(F.flatten(F.flatten(F.transform(start, lambda i: F.transform(above(i), lambda j: F.transform(above(j), lambda k: F.array(tokens[i], tokens[j], tokens[k])))))))
    if not 1 <= most <= 3:
        raise ValueError("combinations of 1 to 3")
    return F.concat(*parts)


def pattern_text(tokens: Column) -> Column:
    return F.array_join(tokens, SEPARATOR)


def pattern_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def parse_pattern(text: Column) -> Column:
    """Sorted distinct tokens of a pattern's text."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, "&&"), lambda t: F.trim(t)), lambda t: t != "")))


def matches(pattern: Column, tokens: Column) -> Column:
    return F.size(F.array_except(pattern, tokens)) == 0


def marked(features: DataFrame, events: DataFrame) -> DataFrame:
    """features with `__hit`, 1 where an event (scode, trade_date) has the bar, else null.

    An array of a symbol's event days meets its bars by symbol, in which both are dealt and sorted already: a join by symbol and day would send all tokens through an exchange.
    """
    days = events.groupBy("scode").agg(F.collect_set("trade_date").alias("__days"))
    found = features.join(days, "scode", "left")
    return found.select(*features.columns, F.when(F.array_contains("__days", F.col("trade_date")), 1).alias("__hit"))


def met(features: DataFrame, events: DataFrame) -> DataFrame:
    """The features of events (scode, trade_date), each once."""
    return marked(features, events).where("__hit = 1").drop("__hit")


def carried(features: DataFrame) -> list[str]:
    """The columns that hold the tokens of a bar: texts, or the packed day and week."""
    return ["tokens"] if "tokens" in features.columns else ["d", "w"]


def with_tokens(features: DataFrame) -> DataFrame:
    """features with their tokens as texts."""
    if carried(features) == ["tokens"]:
        return features
    both = F.array(*X.unpacked(F.col("d"), X.rule_names(X.DAILY)), *X.unpacked(F.col("w"), X.rule_names(X.WEEKLY)))
    return features.withColumn("tokens", F.sort_array(F.array_compact(both))).drop("d", "w")


def holdings(batch: pa.RecordBatch, vocabulary: list[str]) -> np.ndarray:
    """A row for each token and a column for each bar of the batch: 1 where the bar has the token."""
    out = np.zeros((len(vocabulary), batch.num_rows), np.uint8)
    if "tokens" not in batch.schema.names:
        number = {t: i for i, t in enumerate(vocabulary)}
        for column, kind in (("d", X.DAILY), ("w", X.WEEKLY)):
            bars = batch.column(column).to_numpy(zero_copy_only=False)
            for i, rule in enumerate(X.rule_names(kind)):
                found = bars >> (X.RULE_BITS * i) & ((1 << X.RULE_BITS) - 1)
                for k, token in enumerate(rule, 1):
                    if token in number:
                        out[number[token]] = found == k
        return out
    lists = batch.column("tokens")
    numbers = pc.index_in(lists.flatten(), pa.array(vocabulary, pa.string()))
    bars = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    known = pc.is_valid(numbers).to_numpy(zero_copy_only=False)
    out[numbers.fill_null(0).to_numpy(zero_copy_only=False)[known], bars[known]] = 1
    return out


def having(held: np.ndarray, pattern: Sequence[int]) -> np.ndarray:
    """1 for each bar that has all tokens (numbers) of a pattern."""
    out = held[pattern[0]]
    for t in pattern[1:]:
        out = out & held[t]
    return out


def pair_counts(features: DataFrame, vocabulary: list[str]) -> DataFrame:
    """a, b (numbers of tokens from 1, a <= b), and the bars with both, all and those with a __hit; a = b counts the token by itself.

    The bars of a batch are a matrix of tokens, whose product with itself has all pairs' counts; a task sends one row for each pair.
    """
    names = sorted(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(names), len(names)), np.int64)
        for batch in batches:
            held = holdings(batch, names).astype(np.float32)
            hit = held[:, pc.is_valid(batch.column("__hit")).to_numpy(zero_copy_only=False)]
            total += [(x @ x.T).astype(np.int64) for x in (held, hit)]  # exact: a batch has fewer than 2^24 bars
        a, b = np.nonzero(np.triu(total[0]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a + 1, b + 1, total[0][a, b], total[1][a, b])], names=["a", "b", "n", "k"])

    counted = features.select(*carried(features), "__hit").mapInArrow(count, "a long, b long, n long, k long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("sample_count"), F.sum("k").alias("success_count"))


#: Patterns that bars are held against one by one; they are a list on the driver. More are met by division.
LISTED = 20_000


def listed(patterns: DataFrame, column: str = "pattern_items") -> list[list[str]] | None:
    """The arrays of a column in the frame's order, or None where there are more than LISTED."""
    rows = [r[0] for r in patterns.select(column).limit(LISTED + 1).collect()]
    return rows if len(rows) <= LISTED else None


def _numbered(patterns: list[list[str]]) -> tuple[list[str], list[list[int]]]:
    names = sorted({t for p in patterns for t in p})
    number = {t: i for i, t in enumerate(names)}
    return names, [[number[t] for t in p] for p in patterns]


def first_matches(features: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """scode, trade_date, `place` (from 0, in the list) of the first pattern that the bar has, and how many it has; bars without any are left out."""
    names, numbers = _numbered(patterns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = holdings(batch, names)
            place, many, left = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, np.uint8)
            for i, p in enumerate(numbers):
                has = having(held, p)
                many += has
                first = has & left
                if first.any():
                    place[first.view(bool)] = i
                    left &= 1 - has
            yield pa.RecordBatch.from_arrays([batch.column("scode"), batch.column("trade_date"), pa.array(place), pa.array(many)], names=["scode", "trade_date", "place", "pattern_count"]).filter(pa.array(many > 0))

    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    return features.select("scode", "trade_date", *carried(features)).mapInArrow(find, f"scode {kinds['scode']}, trade_date {kinds['trade_date']}, place long, pattern_count long")


def match_counts(features: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """place (in the list), sample_count and success_count of each pattern that bars have; features have a __hit."""
    names, numbers = _numbered(patterns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(numbers)), np.int64)
        for batch in batches:
            held, hit = holdings(batch, names), pc.is_valid(batch.column("__hit")).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, p in enumerate(numbers):
                has = having(held, p)
                total[:, i] += np.count_nonzero(has), np.count_nonzero(has & hit)
        i = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, total[0][i], total[1][i])], names=["place", "n", "k"])

    counted = features.select(*carried(features), "__hit").mapInArrow(count, "place long, n long, k long")
    return counted.groupBy("place").agg(F.sum("n").alias("sample_count"), F.sum("k").alias("success_count"))


def support(events: DataFrame, features: DataFrame, most: int = 2) -> DataFrame:
    """pattern (text) and its number of events (scode, trade_date) with full windows; patterns of any size, those above 3 level by level."""
    if most > 3:
        return frequent(features, events, most)
    own = met(features, events)
    return own.select(F.explode(combinations(F.col("tokens"), most)).alias("c")).groupBy(pattern_text(F.col("c")).alias("pattern")).agg(F.count("*").alias("positive_support"))


def frequent(features: DataFrame, events: DataFrame, most: int, least_support: int = 1) -> DataFrame:
    """pattern, positive_support and feature_count of the token sets of 1 to `most` that `least_support` events have."""
    own = met(features, events).select(F.col("tokens").alias("items"))
    found = itemsets.frequent_itemsets(own, least_support, most)
    return found.select(pattern_text(F.col("items")).alias("pattern"), F.col("support").alias("positive_support"), F.size("items").alias("feature_count"))


def matched(features: DataFrame, patterns: DataFrame) -> DataFrame:
    """scode, trade_date and pattern: every bar with each stored pattern (text, of any size) that it matches."""
    wanted = patterns.select("pattern").distinct().withColumn("pattern_items", parse_pattern(F.col("pattern")))
    return itemsets.divided(features.select("scode", "trade_date", "tokens"), wanted, "tokens").drop("pattern_items")


def rates(patterns: DataFrame, features: DataFrame, positives: DataFrame) -> DataFrame:
    """pattern, sample_count, success_count and success_rate of stored patterns of any size over all bars; those that no bar matches are left out."""
    wanted = patterns.select("pattern").distinct().select("pattern", parse_pattern(F.col("pattern")).alias("pattern_items")).where(F.size("pattern_items") > 0)
    wanted = stored(wanted, "wanted")
    rows, few = marked(features, positives), listed(wanted)
    if few is None:
        hits = matched(with_tokens(rows).select("scode", F.struct("trade_date", "__hit").alias("trade_date"), "tokens"), wanted)
        counted = hits.groupBy("pattern").agg(F.count("*").alias("sample_count"), F.count("trade_date.__hit").alias("success_count"))
    else:
        distinct = sorted(set(map(tuple, few)))
        places = features.sparkSession.createDataFrame([(i, list(p)) for i, p in enumerate(distinct)], "place long, pattern_items array<string>")
        counted = match_counts(rows, [list(p) for p in distinct]).join(places, "place").join(wanted, "pattern_items").select("pattern", "sample_count", "success_count")
    return counted.withColumn("success_rate", F.col("success_count") / F.col("sample_count"))


def evaluate(candidates: DataFrame, features: DataFrame, positives: DataFrame, most: int = 2, thresholds: tuple[float, ...] = (0.5,), least_samples: int = 1) -> DataFrame:
    """One row for each candidate and threshold that it passes, over every bar with full windows.

    Combinations of a bar's tokens meet the candidates by an equal join after they are counted by pattern, so the join is between
    two tables of patterns and no pair of bar and candidate is ever made. Candidates of more than 3 tokens are found by division instead.
    """
    if most > 3:
        found = candidates.join(rates(candidates, features, positives), "pattern")
        return _passed(found, thresholds, least_samples)
    counted = with_tokens(marked(features, positives)).select(F.explode(combinations(F.col("tokens"), most)).alias("c"), "__hit").groupBy(pattern_text(F.col("c")).alias("pattern")).agg(
        F.count("*").alias("sample_count"), F.count("__hit").alias("success_count"))
    return _passed(candidates.join(counted, "pattern").withColumn("success_rate", F.col("success_count") / F.col("sample_count")), thresholds, least_samples)


def _passed(found: DataFrame, thresholds: tuple[float, ...], least_samples: int) -> DataFrame:
    """A row for each threshold that a pattern passes."""
    found = found.where((F.col("sample_count") >= least_samples) & (F.col("success_rate") >= min(thresholds)))
    passed = F.filter(F.array(*[F.lit(t) for t in sorted(thresholds)]), lambda t: t <= F.col("success_rate"))
    return found.withColumn("min_success_rate", F.explode(passed)).withColumn("feature_count", F.size(F.split("pattern", SEPARATOR)))


def mined(features: DataFrame, positives: DataFrame, vocabulary: list[str], most: int = 2, least_support: int = 1, thresholds: tuple[float, ...] = (0.0,), least_samples: int = 1) -> DataFrame:
    """Candidates and their evaluation in one pass, where the events that support a pattern are those that it is tested with.

    As an event has one bar, a pattern's support is its number of successes, so each bar's combinations are counted once, with and without an event. Tokens
    are numbered by the vocabulary (sorted; its size does not follow the data), a combination is one integer, and text is made of those that are left.
    Up to 2 tokens no bar's combinations become rows: they are counted by matrix products. Beyond 3 tokens candidates come level by level from the events, and are evaluated by division; they have no code.
    """
    if most > 3:
        found = evaluate(frequent(features, positives, most, least_support).drop("feature_count"), features, positives, most, thresholds, least_samples)
        return found.select("pattern", F.lit(None).cast("long").alias("code"), "positive_support", "sample_count", "success_count", "success_rate", "min_success_rate", "feature_count")
    rows = marked(features, positives)
    if most <= 2:
        pairs = pair_counts(rows, vocabulary).where(F.lit(most == 2) | (F.col("a") == F.col("b")))
        counted = pairs.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.shiftleft("a", TOKEN_BITS).bitwiseOR(F.col("b"))).alias("code"), "sample_count", "success_count")
    else:
        counted = with_tokens(rows).select(F.explode(codes(F.col("tokens"), vocabulary, most)).alias("code"), "__hit").groupBy("code").agg(F.count("*").alias("sample_count"), F.count("__hit").alias("success_count"))
    found = counted.where((F.col("success_count") >= least_support) & (F.col("sample_count") >= least_samples)).withColumn("success_rate", F.col("success_count") / F.col("sample_count"))
    passed = F.filter(F.array(*[F.lit(t) for t in sorted(thresholds)]), lambda t: t <= F.col("success_rate"))
    found = found.withColumn("min_success_rate", F.explode(passed)).withColumn("pattern", decoded(F.col("code"), vocabulary))
    return found.select("pattern", "code", F.col("success_count").alias("positive_support"), "sample_count", "success_count", "success_rate", "min_success_rate", F.size(F.split("pattern", SEPARATOR)).alias("feature_count"))


#: Numbers of tokens fit into so many bits of a combination's code.
TOKEN_BITS = 16


def codes(tokens: Column, vocabulary: list[str], most: int) -> Column:
    """All combinations of one to `most` (1 to 3) tokens of a sorted array as integers: the numbers of the tokens (from 1), the first in the highest bits."""
    if not 1 <= most <= 3:
        raise ValueError("combinations of 1 to 3")
    number = F.create_map(*[F.lit(x) for i, t in enumerate(sorted(vocabulary), 1) for x in (t, i)])

    def longer(shorter: Column, ns: Column) -> Column:
        """Each combination with each token that comes after its last one; tokens are sorted, and so are their numbers."""
        last = F.lit((1 << TOKEN_BITS) - 1)
        return F.flatten(F.transform(shorter, lambda c: F.transform(F.filter(ns, lambda n: n > c.bitwiseAND(last)), lambda n: F.shiftleft(c, TOKEN_BITS).bitwiseOR(n))))

    def all_of(ns: Column) -> Column:
        parts = [ns]
        for _ in range(most - 1):
            parts.append(longer(parts[-1], ns))
        return F.concat(*parts)

    # bound by an array of one, so that tokens are numbered once
    return F.flatten(F.transform(F.array(F.transform(tokens, lambda t: number[t].cast("long"))), all_of))


def decoded(code: Column, vocabulary: list[str]) -> Column:
    """The text of a combination's code."""
    names = F.array(*[F.lit(t) for t in sorted(vocabulary)])
    parts = [F.shiftright(code, TOKEN_BITS * i).bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)).cast("int") for i in (2, 1, 0)]
    return F.array_join(F.array_compact(F.array(*[F.when(p > 0, F.element_at(names, F.greatest(p, F.lit(1)))) for p in parts])), SEPARATOR)


def token_vocabulary(features: DataFrame) -> list[str]:
    """All tokens that occur; a few dozen, as the rules make them."""
    return [r[0] for r in features.select(F.explode("tokens").alias("t")).distinct().orderBy("t").collect()]


def most_common(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """The `limit` values of a column that occur most often, with their number and share of all rows; ties by value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("__total"))
    return counts.orderBy(F.desc("n"), column).limit(limit).crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__total")).alias("rate"))


def ordered(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy("min_success_rate", F.desc("success_rate"), F.desc("success_count"), F.desc("sample_count"), "pattern")


def signatures(features: DataFrame, positives: DataFrame) -> DataFrame:
    """The whole token set as one pattern: samples, successes and rate."""
    rows = marked(features, positives).select(pattern_text(F.col("tokens")).alias("signature"), "__hit")
    return rows.groupBy("signature").agg(F.count("*").alias("sample_count"), F.count("__hit").alias("success_count")).withColumn("success_rate", F.col("success_count") / F.col("sample_count"))


def best_pattern_per_stock(features: DataFrame, patterns: DataFrame, vocabulary: list[str], most: int = 2) -> DataFrame:
    """For each bar that any pattern (with its code, as mined() gives it) matches: the best one by success rate, and how many match."""
    best_first = patterns.groupBy("code").agg(F.max("success_rate").alias("score"), F.first("pattern").alias("pattern"))
    best_first = stored(best_first.select("score", "pattern", parse_pattern(F.col("pattern")).alias("pattern_items")), "good")
    few = listed(best_first)
    if few is None or most > 2:
        exploded = with_tokens(features).select("scode", "trade_date", F.explode(codes(F.col("tokens"), vocabulary, most)).alias("code"))
        hits = exploded.join(patterns.groupBy("code").agg(F.max("success_rate").alias("score"), F.first("pattern").alias("pattern")), "code")
        return hits.groupBy("scode", "trade_date").agg(F.max(F.struct(F.col("score"), F.col("pattern"))).alias("b"), F.count("*").alias("pattern_count")).select("scode", "trade_date", F.col("b.score").alias("score"), F.col("b.pattern").alias("pattern"), "pattern_count")
    rows = [tuple(r) for r in best_first.orderBy(F.desc("score"), F.desc("pattern")).collect()]
    return _named(first_matches(features, [r[2] for r in rows]), [(i, *r[:2]) for i, r in enumerate(rows)], "place long, score double, pattern string").select("scode", "trade_date", "score", "pattern", "pattern_count")


def _named(found: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Bars with what the list says of their place; a row for each listed pattern."""
    return found.join(F.broadcast(found.sparkSession.createDataFrame(rows, schema)), "place")


def selection_order(found: DataFrame, closes: DataFrame, limit: int) -> DataFrame:
    """The day's matches (score, pattern_count) by score, number of patterns and close, the first `limit`."""
    return found.join(closes.select("scode", "trade_date", "close"), ["scode", "trade_date"]).orderBy(F.desc("score"), F.desc("pattern_count"), F.desc("close"), "scode", "trade_date").limit(limit)


def goal_search(features: DataFrame, train: DataFrame, held: DataFrame, sizes: tuple[int, ...], supports: tuple[int, ...], goal: float, least_samples: int = 1) -> DataFrame:
    """The grid of sizes and supports, from large supports down: the patterns of the first point that has any which reach the goal on the held events too.

    The patterns of a size are counted once for the whole grid, with the events of both sets, and kept as a stored table.
    """
    keep = ("pattern", "positive_support", "sample_count", "success_count", "success_rate", "min_success_rate", "feature_count")
    for size in sizes:
        own = support(train, features, size).where(F.col("positive_support") >= min(supports))
        own = stored(evaluate(own, features, train, size, (goal,), least_samples).select("pattern", "positive_support"), "goal")
        both = stored(evaluate(own, features, held, size, (goal,), least_samples), "held")
        released(own)
        most = both.agg(F.max("positive_support")).first()[0]
        least = max((x for x in supports if most is not None and x <= most), default=None)
        if least is not None:
            return both.where(F.col("positive_support") >= least).select(*keep)
        released(both)
    none = support(train, features, 1).where("false").withColumns({"sample_count": F.lit(0).cast("long"), "success_count": F.lit(0).cast("long"), "success_rate": F.lit(0.0)})
    return _passed(none, (goal,), least_samples).select(*keep)


def evenly_spaced(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """`limit` rows at equal distances in the given order, the first and the last included. Rows are counted by the first column of the order."""
    n = rows.count()
    if n <= limit:
        return rows
    picks = sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)}) if limit > 1 else [0]
    return ordinals(rows, F.col(order[0]), [F.col(c) for c in order], "__n").where(F.col("__n").isin(picks)).drop("__n")


def proposed(responses: DataFrame, vocabulary: DataFrame, response: str = "response") -> DataFrame:
    """Valid patterns of model responses: the outermost JSON object's `patterns` whose tokens are all known; sorted, distinct."""
    parsed = responses.select(F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), "patterns array<array<string>>")["patterns"].alias("patterns"))
    wanted = parsed.select(F.explode("patterns").alias("p")).select(F.array_sort(F.array_distinct("p")).alias("p")).where(F.size("p") > 0).distinct()
    tokens = wanted.withColumn("token", F.explode("p")).join(vocabulary.select("token", F.lit(1).alias("known")), "token", "left")
    good = tokens.groupBy("p").agg(F.count("*").alias("n"), F.count("known").alias("k")).where("n = k")
    return good.select(pattern_text(F.col("p")).alias("pattern"))


def rate_list(text: str) -> list[float]:
    """0.5,60 -> [0.5, 0.6]: shares or percents, sorted and distinct."""
    values = {float(x) / 100 if float(x) > 1 else float(x) for x in text.replace(";", ",").split(",") if x.strip()}
    return sorted(values)


def weight_grid(start: str, end: str, step: str) -> list[float]:
    """Decimal-exact steps from start to end."""
    from decimal import Decimal

    a, b, s = Decimal(start), Decimal(end), Decimal(step)
    return [float(a + i * s) for i in range(math.floor((b - a) / s) + 1)]


def signature_search(features: DataFrame, train: DataFrame, held: DataFrame, supports: tuple[int, ...], goal: float) -> DataFrame:
    """The signatures with the largest support that reach the goal in training and, held out, too; empty where none do."""
    inside, outside = signatures(features, train).where(F.col("success_rate") >= goal), signatures(features, held).where(F.col("success_rate") >= goal)
    for least in sorted(supports, reverse=True):
        found = inside.where(F.col("success_count") >= least).select("signature", F.col("success_count").alias("positive_support")).join(outside, "signature")
        if found.take(1):
            return found
    return inside.where("false").select("signature", F.col("success_count").alias("positive_support")).join(outside, "signature")


def estimated_support(proposals: DataFrame, counted: DataFrame) -> DataFrame:
    """Proposed patterns with the support of their pair where it was counted, else the least support of their tokens."""
    known = counted.select("pattern", "positive_support")
    whole = proposals.join(known, "pattern", "left")
    tokens = whole.withColumn("token", F.explode(F.split("pattern", SEPARATOR))).join(known.select(F.col("pattern").alias("token"), F.col("positive_support").alias("single")), "token", "left")
    return tokens.groupBy("pattern").agg(F.coalesce(F.first("positive_support"), F.min("single"), F.lit(0)).alias("positive_support"))

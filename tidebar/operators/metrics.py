"""Ranking and classification metrics over scored rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import ordinals

DEPTHS = (5, 10, 20, 50, 100, 200, 500)
CLASSES = ("positive", "negative", "neutral")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def binary_confusion(rows: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn, precision and recall at a threshold."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    out = rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))])
    return out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})


def precision_at(rows: DataFrame, ties: list[str], depths: tuple[int, ...] = DEPTHS, score: str = "score", label: str = "label") -> DataFrame:
    """k and the share of ones among the k best, of min(k, n) rows. Only the deepest k rows are ranked."""
    order = [F.desc_nulls_last(score), *ties]
    top = rows.orderBy(*order).limit(max(depths)).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    grid = top.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in depths]), lambda k: k >= F.col("n"))))
    return grid.groupBy("k").agg((F.count(F.when(F.col(label) == 1, 1)) / F.count("*")).alias("precision"))


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, classes: tuple[str, ...] = CLASSES, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1 and support of each class."""
    n = confusion(rows, actual, predicted)
    parts = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.when((F.col(actual) == c) & (F.col(predicted) == c), F.col("n")).otherwise(0).alias("tp"),
                                                    F.when(F.col(actual) == c, F.col("n")).otherwise(0).alias("a"), F.when(F.col(predicted) == c, F.col("n")).otherwise(0).alias("p")) for c in classes])).alias("x")).select("x.*")
    total = parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "a", "p")])
    out = total.select("class", share(F.col("tp"), F.col("p")).alias("precision"), share(F.col("tp"), F.col("a")).alias("recall"), F.col("a").alias("support"))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall_report(rows: DataFrame, classes: tuple[str, ...] = CLASSES, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, and the mean of the classes' f1."""
    right = rows.agg(share(F.count(F.when(F.col(actual) == F.col(predicted), 1)), F.count("*")).alias("accuracy"))
    return right.crossJoin(F.broadcast(class_report(rows, classes, actual, predicted).agg(F.avg("f1").alias("macro_f1"))))


def gate(report: DataFrame, least: dict[str, float]) -> DataFrame:
    """A one-row report with `passed`: whether every named metric reaches its bound (null does not)."""
    good = F.lit(True)
    for name, bound in least.items():
        good = good & F.coalesce(F.col(name) >= bound, F.lit(False))
    return report.withColumn("passed", good)


def low_score_rate(rows: DataFrame, floor: float = 0.45, score: str = "score", label: str = "label") -> DataFrame:
    ones = F.col(label) == 1
    return rows.agg(share(F.count(F.when(ones & (F.col(score) < floor), 1)), F.count(F.when(ones, 1))).alias("low_score_rate"))


def next_threshold(rows: DataFrame, position: float, score: str = "score", clip: bool = True) -> DataFrame:
    """avg + position x (max - avg)."""
    value = F.avg(score) + position * (F.max(score) - F.avg(score))
    return rows.agg((F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clip else value).alias("threshold"))


def chunked_confusion(rows: DataFrame, order: list[str], threshold: float, size: int = 1000, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion of each chunk of `size` rows, in order. Rows are counted by the first column of the order, so no task numbers them all."""
    placed = ordinals(rows.select(*dict.fromkeys([*order, score, label])), F.col(order[0]), [F.col(c) for c in order], "__n")
    numbered = placed.withColumn("chunk", (F.col("__n") / size).cast("long"))
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    return numbered.groupBy("chunk").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))])


def group_ranks(rows: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """rank of the positive within its group, and how many groups have it there."""
    w = Window.partitionBy(*group).orderBy(F.desc(score))
    ranked = rows.withColumn("r", F.rank().over(w)).where(F.col(label) == 1)
    return ranked.groupBy(F.col("r").alias("rank")).agg(F.count("*").alias("groups"))


def group_extremes(rows: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Groups with a positive, and in how many of them it is the first or the last by score."""
    up, down = (Window.partitionBy(*group).orderBy(o) for o in (F.desc(score), F.asc(score)))
    ranked = rows.withColumns({"__up": F.rank().over(up), "__down": F.rank().over(down)}).where(F.col(label) == 1)
    best = ranked.groupBy(*group).agg(F.min("__up").alias("up"), F.min("__down").alias("down"))
    return best.agg(F.count("*").alias("groups"), F.count(F.when(F.col("up") == 1, 1)).alias("top1"), F.count(F.when(F.col("down") == 1, 1)).alias("bottom1"))


def decayed_weights(rows: DataFrame, group: list[str], bottom: int, factor: float, score: str = "score", label: str = "label", weight: str = "weight") -> DataFrame:
    """Weights of positives that are among the `bottom` lowest of their group, times the factor."""
    w = Window.partitionBy(*group).orderBy(F.asc(score))
    low = (F.rank().over(w) <= bottom) & (F.col(label) == 1)
    return rows.withColumn(weight, F.when(low, F.col(weight) * factor).otherwise(F.col(weight)))


def joint_rerank(up: DataFrame, down: DataFrame, top: int, weight: float, key: list[str]) -> DataFrame:
    """The `top` rows by up score, ranked by up - weight x down (0 where there is none)."""
    best = up.orderBy(F.desc_nulls_last("up"), *key).limit(top)
    scored = best.join(down.select(*key, "down"), key, "left").withColumn("combined", F.col("up") - weight * F.coalesce("down", F.lit(0.0)))
    return scored.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("combined"), *key)))


def weight_sweep(scored: DataFrame, weights: list[float], key: list[str], k: int = 20) -> DataFrame:
    """precision of the k best by up - weight x down, for each weight."""
    grid = scored.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    combined = grid.withColumn("combined", F.col("up") - F.col("weight") * F.col("down"))
    w = Window.partitionBy("weight").orderBy(F.desc("combined"), *key)
    top = combined.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return top.groupBy("weight").agg((F.count(F.when(F.col("label") == 1, 1)) / F.count("*")).alias("precision"))


def scored_by(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], column: str = "score") -> DataFrame:
    """rows with what a scorer gives for each batch; the scorer is any function from a pandas frame to numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{column: scorer(frame).astype("float64")})

    kept = [f for f in rows.schema.fields if f.name != column]
    return rows.select([f.name for f in kept]).mapInPandas(run, rows.select([f.name for f in kept]).schema.add(column, "double"))


def predict_day(windows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], threshold: float, limit: int) -> DataFrame:
    """Rows whose score reaches the threshold, the best `limit` with rank_no."""
    hits = scored_by(windows, scorer).where(F.col("score") >= threshold)
    best = hits.orderBy(F.desc("score"), "scode").limit(limit)
    return best.withColumn("rank_no", F.row_number().over(Window.orderBy(F.desc("score"), "scode")))

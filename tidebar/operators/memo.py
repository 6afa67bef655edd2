"""Calls to a model that are made once: memoised scores, heads that follow as scores come in, and batches that halve when they fail.

The model is the caller's function; it runs in tasks on batches, and what it said is a stored table, so a later call, or a run that was stopped, asks only for
what is not there yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.sources.scratch import released, stored
from tidebar.sources.store import exists

from .metrics import scored_by


def memoized_scores(rows: DataFrame, keys: Sequence[str], model: str, scorer: Callable[[pd.DataFrame], pd.Series], path: str) -> DataFrame:
    """rows with the model's score. Keys that the table at `path` (keys, score, in folders by model) lacks are scored, each once, and added to it.

    Rows with a null key are not scored. The new scores are written before they are added, so no call is lost or made twice when the job fails behind them.
    """
    spark, keys = rows.sparkSession, list(keys)
    folder = f"{path}/model={model}"
    wanted = rows.dropna(subset=keys).dropDuplicates(keys)
    if exists(spark, folder):
        wanted = wanted.join(spark.read.parquet(folder).select(*keys), keys, "left_anti")
    fresh = stored(scored_by(wanted, scorer).select(*keys, "score"), "scores")
    if fresh.take(1) or not exists(spark, folder):
        fresh.write.mode("append").parquet(folder)
    released(fresh)
    return rows.join(spark.read.schema(fresh.schema).parquet(folder), keys, "left")


def merged_head(head: DataFrame | None, scored: DataFrame, limit: int, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The `limit` best of each group `by` over an earlier head and new scores: what all scores so far would give, as a head keeps all that can be in it.

    A key that was in the head already counts once, with its latest score (scored wins).
    """
    rows = scored.select(*by, *[k for k in keys if k not in by], "score")
    if head is not None:
        rows = rows.unionByName(head.select(rows.columns).join(rows.select(*keys).distinct(), list(keys), "left_anti"))
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("score"), *keys)
    return rows.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= limit)


ANSWERS = "item string, answer array<string>, calls int"


def answered(items: DataFrame, ask: Callable[[list[str]], list[list[str]]], path: str, size: int = 16, fallback: Callable[[str], list[str]] | None = None) -> DataFrame:
    """item and answer of every distinct item (a column of text), from a function that takes a list of items and may fail as a whole.

    Round by round, each open batch is asked in a task; one that fails is split into halves for the next round, and a single item that fails gets its fallback's
    answer, or none (null). Answers are stored at `path` after each round, and items that have one there are never asked again. A failing item costs as
    many calls as the logarithm of the batch. calls: in how many calls the item took part.
    """
    spark = items.sparkSession
    wanted = items.select(F.col("item").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    if exists(spark, path):
        wanted = wanted.join(spark.read.parquet(path).select("item"), "item", "left_anti")
    numbered = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(1 << 16)))
    # batches of `size` within a block of hashes: no task numbers all items
    place = F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1
    batches = numbered.withColumn("batch", F.concat_ws("-", "block", F.floor(place / size))).groupBy("batch").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pending = stored(_joined_small(batches, size).withColumn("calls", F.lit(0)), "batches")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for batch, asked, calls in zip(frame["batch"], frame["items"], frame["calls"]):
                asked = list(asked)
                try:
                    said = ask(asked)
                    if len(said) != len(asked):
                        raise ValueError("an answer for each item is needed")
                    out += [(batch, [i], True, list(a), calls + 1) for i, a in zip(asked, said)]
                except Exception:  # the service's failure is data here: the batch is split
                    if len(asked) == 1:
                        out.append((batch, asked, True, fallback(asked[0]) if fallback else None, calls + 1))
                    else:
                        half = len(asked) // 2
                        out += [(f"{batch}.{n}", part, False, None, calls + 1) for n, part in enumerate((asked[:half], asked[half:]))]
            yield pd.DataFrame(out, columns=["batch", "items", "done", "answer", "calls"])

    while pending.take(1):
        asked = stored(pending.repartition("batch").mapInPandas(call, "batch string, items array<string>, done boolean, answer array<string>, calls int"), "asked")
        asked.where("done").select(F.col("items")[0].alias("item"), "answer", "calls").write.mode("append").parquet(path)
        released(pending)
        pending = stored(asked.where("NOT done").select("batch", "items", "calls"), "batches")
        released(asked)
    released(pending)
    if not exists(spark, path):
        return spark.createDataFrame([], ANSWERS)
    return items.select(F.col("item").cast("string").alias("item")).distinct().join(spark.read.schema(ANSWERS).parquet(path), "item")


def _joined_small(batches: DataFrame, size: int) -> DataFrame:
    """Batches of neighbouring blocks put together while they are small: by a window over blocks of blocks, each bounded."""
    spread = batches.select(F.pmod(F.xxhash64("batch"), F.lit(64)).alias("b"), "batch", F.explode("items").alias("item"))
    n = spread.count()
    if n > size * 4096:  # large enough as they are
        return batches
    place = F.row_number().over(Window.partitionBy("b").orderBy("batch", "item")) - 1
    return spread.withColumn("batch", F.concat_ws("-", "b", F.floor(place / size))).groupBy("batch").agg(F.array_sort(F.collect_list("item")).alias("items"))

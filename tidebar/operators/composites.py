"""Whole data sets, made again by a model's scores: harder negatives, or without the easy positives. Each writes its parts, the scores and a manifest.

Rows have scode, trade_date, a label of 1 or 0, and whatever else a sample carries. The scorer runs in tasks and is asked once for each key; its scores are
kept below the output, so a run that stopped asks only for the rest.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalars import stable_rank
from tidebar.sources import store
from tidebar.sources.scratch import released, stored

from .datasets import by_score, positive_reshuffle, reshuffle
from .labels import classify_anchors
from .memo import memoized_scores

KEY = ["scode", "trade_date"]
Scorer = Callable[[pd.DataFrame], pd.Series]


def kind_plan(positives: int, ratio: float = 9.0, drop6_ratio: float = 3.0, kept: Mapping[str, float] | None = None) -> dict[str, tuple[int, int]]:
    """For each kind of negative how many are wanted, and how many of these may be hard ones that stay: multiples of the positives, halves to even.

    Drops are wanted first, up to all negatives; neutral rows are the rest.
    """
    kept = kept or {"drop6": 1.0, "neutral": 1.0}
    wanted = round(positives * max(0.0, ratio))
    drops = min(wanted, round(positives * max(0.0, drop6_ratio)))
    return {kind: (n, min(n, round(positives * max(0.0, kept[kind])))) for kind, n in (("drop6", drops), ("neutral", wanted - drops))}


def _manifest(spark, told: dict, path: str) -> dict:
    text = json.dumps(told, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return told


def _write_parts(parts: Mapping[str, DataFrame], path: str, seed: int) -> None:
    """Each part, and all of them, as lines of JSON in an order by hash."""
    order = stable_rank(seed, F.lit("order"), *[F.col(k) for k in KEY])
    for name, rows in parts.items():
        store.write_jsonl(rows.orderBy(order, *KEY), f"{path}/{name}")
    whole = None
    for rows in parts.values():
        whole = rows if whole is None else whole.unionByName(rows)
    store.write_jsonl(whole, f"{path}/all")


def reshuffle_negatives(parts: Mapping[str, DataFrame], pool: DataFrame, bars: DataFrame, scorer: Scorer, model: str, path: str, ratio: float = 9.0, drop6_ratio: float = 3.0,
                        kept: Mapping[str, float] | None = None, drop: float = 0.06, steps: int = 3, seed: int = 7) -> dict:
    """Write parts (train and test, say) in which the negatives that the model scores highest stay and the others are drawn anew from `pool`; the manifest is returned.

    Negatives are of the kind drop6 if their next bars fall by `drop`, else neutral, and each kind is planned by `kind_plan`. The pool's rows that any part has
    are not drawn, and what one part has taken, the next ones cannot. Raises ValueError where there are no negatives, or the pool has too few of a kind.
    """
    spark = bars.sparkSession
    columns = next(iter(parts.values())).columns
    own = [rows.where("label = 0").select(columns).withColumn("__part", F.lit(name)) for name, rows in parts.items()]
    united = own[0]
    for rows in own[1:]:
        united = united.unionByName(rows)
    current = stored(united, "negatives")
    once = memoized_scores(current.dropDuplicates(KEY).drop("__part"), KEY, model, scorer, f"{path}/scores")
    scored = stored(classify_anchors(once, bars, drop, steps).withColumn("kind", F.when(F.col("is_drop6"), "drop6").otherwise("neutral")).drop("is_drop6"), "scored")
    available = {r["kind"]: r["count"] for r in scored.groupBy("kind").count().collect()}
    if not available:
        raise ValueError("no part has negatives")
    others = pool.where("label = 0").select(columns).join(scored.select(KEY), KEY, "left_anti").dropDuplicates(KEY)
    others = stored(classify_anchors(others, bars, drop, steps).withColumn("kind", F.when(F.col("is_drop6"), "drop6").otherwise("neutral")).drop("is_drop6"), "pool")
    taken = spark.createDataFrame([], scored.select(KEY).schema)
    told = {"model": model, "seed": seed, "ratio": ratio, "drop6_ratio": drop6_ratio, "drop": drop, "steps": steps, "scored": available}
    out, steps_kept = {}, [current, scored, others]
    for name, rows in parts.items():
        positives = rows.where("label = 1").select(columns)
        n = positives.count()
        plan = kind_plan(n, ratio, drop6_ratio, kept)
        mine = scored.join(current.where(F.col("__part") == name).select(KEY).distinct(), KEY, "left_semi").join(taken, KEY, "left_anti")
        chosen = stored(reshuffle(mine, others, taken, {k: most for k, (_, most) in plan.items()}, {k: total for k, (total, _) in plan.items()}, seed), "chosen")
        hard = {r["kind"]: r["count"] for r in chosen.join(mine.select(KEY), KEY, "left_semi").groupBy("kind").count().collect()}
        found = scored.select(columns).unionByName(others.select(columns)).join(chosen.select(KEY), KEY, "left_semi")
        out[name] = positives.unionByName(found.select(columns))
        told[name] = {"positives": n, "negatives": sum(total for total, _ in plan.values()), **{kind: {"wanted": total, "kept": hard.get(kind, 0), "drawn": total - hard.get(kind, 0)} for kind, (total, _) in plan.items()}}
        taken = taken.unionByName(chosen.select(KEY))
        steps_kept.append(chosen)
    _write_parts(out, path, seed)
    store.write_jsonl(scored.select(*KEY, "score", "kind"), f"{path}/negative_scores")
    told["overlap"] = taken.count() - taken.distinct().count()
    released(*steps_kept)
    return _manifest(spark, told, path)


def reshuffle_positives(parts: Mapping[str, DataFrame], scorer: Scorer, model: str, path: str, top_share: float = 0.3, kept_share: float = 0.1, negatives_each: float = 4, seed: int = 7) -> dict:
    """Write parts without most of the positives that the model scores highest, over all parts, and with negatives in ratio to those that stay; the manifest is returned.

    A row stays in its part. The scores of all positives are written beside the parts, highest first.
    """
    spark = next(iter(parts.values())).sparkSession
    columns = next(iter(parts.values())).columns
    united = None
    for name, rows in parts.items():
        marked = rows.select(columns).withColumn("__part", F.lit(name))
        united = marked if united is None else united.unionByName(marked)
    united = stored(united, "rows")
    ones = memoized_scores(united.where("label = 1"), KEY, model, scorer, f"{path}/scores")
    scored = stored(ones.unionByName(united.where("label = 0").withColumn("score", F.lit(None).cast("double"))), "scored")
    chosen = stored(positive_reshuffle(scored, seed, top_share, kept_share, negatives_each), "chosen")
    _write_parts({name: chosen.where(F.col("__part") == name).select(columns) for name in parts}, path, seed)
    store.write_jsonl(by_score(scored.where("label = 1")).select("n", *KEY, "score").orderBy("n"), f"{path}/positive_scores")
    counts = {stage: {(r["__part"], r["label"]): r["count"] for r in rows.groupBy("__part", "label").count().collect()} for stage, rows in (("source", united), ("output", chosen))}
    told = {"model": model, "seed": seed, "top_share": top_share, "kept_share": kept_share, "negatives_each": negatives_each,
            **{name: {f"{stage}_{kind}": counts[stage].get((name, label), 0) for stage in counts for kind, label in (("positives", 1), ("negatives", 0))} for name in parts}}
    released(united, scored, chosen)
    return _manifest(spark, told, path)

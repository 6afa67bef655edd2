"""Cuts of a hash order, whole data sets with their manifests."""

import random

import pytest
from pyspark.sql import functions as F

from tidebar.functions.scalars import stable_rank
from tidebar.operators import composites, datasets


@pytest.mark.parametrize("rows_a_task", [100_000, 3])
def test_lowest_is_a_sorted_head(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(datasets, "SORTED_ROWS", rows_a_task)
    rng = random.Random(4)
    plain = [(rng.choice(["aaa", "aab", f"{rng.randrange(1 << 20):05x}"]) + "0" * 11, f"s{i:03}", "x") for i in range(300)]
    plain = [(r[:16], s, d) for r, s, d in plain]
    rows = spark.createDataFrame(plain, "hash_rank string, scode string, trade_date string")
    for n in (0, 1, 7, 150, 299, 300, 400):
        assert sorted(map(tuple, datasets.lowest(rows, n).collect())) == sorted(plain)[:n]
    assert datasets.lowest(rows.where("false"), 5).count() == 0


def test_split_is_a_sorted_head(spark, monkeypatch):
    monkeypatch.setattr(datasets, "SORTED_ROWS", 2)
    rows = spark.range(500).select(F.col("id").cast("string").alias("scode"))
    ranked = sorted((r.r, r.scode) for r in rows.select(stable_rank(7, F.col("scode")).alias("r"), "scode").collect())
    assert sorted(r.scode for r in datasets.hash_split(rows, 7, ["scode"]).where("is_eval").collect()) == sorted(s for _, s in ranked[:100])
    assert datasets.hash_split(rows.limit(1), 7, ["scode"]).where("is_eval").count() == 0


@pytest.mark.parametrize("count, top, kept", [(0, 0, 0), (1, 1, 1), (11, 4, 1), (40, 12, 2)])
def test_tops_are_rounded_up(spark, count, top, kept):
    rows = spark.range(count + 200).select(F.col("id").cast("string").alias("scode"), F.lit("2026-01-01").alias("trade_date"), (F.col("id") < count).cast("int").alias("label"), (F.col("id") / 1000).alias("score"))
    found = datasets.positive_reshuffle(rows).groupBy("label").count().collect()
    counts = {r.label: r["count"] for r in found}
    assert counts.get(1, 0) == count - top + kept and counts.get(0, 0) == min(200, 4 * (count - top + kept))


def of_digits(frame):
    return frame["scode"].astype(int) % 97 / 97


def made(spark, low, high, label):
    return spark.range(low, high).select(F.format_string("%06d", "id").alias("scode"), F.lit("2026-01-01").cast("date").alias("trade_date"), F.lit(label).alias("label"), F.concat(F.lit("t"), "id").alias("text"))


def bars_of(spark, high):
    """The day of the samples and three more; the symbols that 3 divides fall by a tenth."""
    return spark.range(high).select(F.format_string("%06d", "id").alias("scode"), "id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        "scode", F.date_add(F.lit("2026-01-01").cast("date"), F.col("i")).alias("trade_date"), F.lit(10.0).alias("close"), F.when((F.col("id") % 3 == 0) & (F.col("i") == 2), 9.0).otherwise(9.9).alias("low"))


def test_hard_negatives_stay_and_the_rest_is_drawn(spark, tmp_path):
    parts = {"train": made(spark, 0, 10, 1).unionByName(made(spark, 10, 100, 0)), "test": made(spark, 100, 104, 1).unionByName(made(spark, 104, 150, 0))}
    pool = made(spark, 0, 900, 0)
    told = composites.reshuffle_negatives(parts, pool, bars_of(spark, 900), of_digits, "m", str(tmp_path))
    score = lambda i: (-(i % 97) / 97, i)
    drawn = set()
    for name, low, high, n in (("train", 10, 100, 10), ("test", 104, 150, 4)):
        found = {int(r.scode): r.label for r in spark.read.json(str(tmp_path / name)).collect()}
        zeros = {i for i, label in found.items() if label == 0}
        assert sum(found.values()) == n and len(zeros) == 9 * n and len([i for i in zeros if i % 3 == 0]) == 3 * n
        for kind, rest in (("drop6", [0]), ("neutral", [1, 2])):
            hard = sorted((i for i in range(low, high) if i % 3 in rest), key=score)[:n]
            assert set(hard) <= zeros and told[name][kind]["kept"] == n
        new = {i for i in zeros if not low <= i < high}
        assert len(new) == 7 * n and all(i < 10 or 100 <= i < 104 or i >= 150 for i in new)
        drawn |= zeros if not drawn & zeros else {None}
    assert None not in drawn and told["overlap"] == 0
    assert spark.read.json(str(tmp_path / "all")).count() == 140 and spark.read.json(str(tmp_path / "negative_scores")).count() == 136
    with pytest.raises(ValueError, match="too few"):
        composites.reshuffle_negatives(parts, made(spark, 150, 160, 0), bars_of(spark, 900), of_digits, "m", str(tmp_path / "small"))
    with pytest.raises(ValueError, match="negatives"):
        composites.reshuffle_negatives({"train": made(spark, 0, 10, 1)}, pool, bars_of(spark, 900), of_digits, "m", str(tmp_path / "none"))


def test_plans_of_kinds():
    assert composites.kind_plan(10) == {"drop6": (30, 10), "neutral": (60, 10)}
    assert composites.kind_plan(10, ratio=2) == {"drop6": (20, 10), "neutral": (0, 0)}
    assert composites.kind_plan(0) == {"drop6": (0, 0), "neutral": (0, 0)} and composites.kind_plan(5, ratio=0.5)["drop6"] == (2, 2)


def test_easy_positives_go(spark, tmp_path):
    parts = {"train": made(spark, 0, 30, 1).unionByName(made(spark, 100, 300, 0)), "test": made(spark, 30, 41, 1).unionByName(made(spark, 300, 400, 0))}
    told = composites.reshuffle_positives(parts, of_digits, "m", str(tmp_path))
    found = {name: spark.read.json(str(tmp_path / name)).collect() for name in parts}
    ones = {int(r.scode) for rows in found.values() for r in rows if r.label == 1}
    # of 41, the 13 best are 28 to 40; two of them stay
    assert set(range(28)) <= ones and len(ones) == 30 and sum(r.label == 0 for rows in found.values() for r in rows) == 120
    assert all(int(r.scode) < 30 or 100 <= int(r.scode) < 300 for r in found["train"]) and told["train"]["source_positives"] == 30
    assert told["train"]["output_negatives"] + told["test"]["output_negatives"] == 120
    assert [int(r.scode) for r in spark.read.json(str(tmp_path / "positive_scores")).orderBy("n").collect()] == list(range(40, -1, -1))

"""Scores asked once, batches that halve, numbered lines, sources that fail, cooldowns without bars, written splits."""

import datetime as dt
import json
import random

import pandas as pd
import pytest

from tidebar import run
from tidebar.operators import datasets, memo, news
from tidebar.sources import store


def counting(folder):
    """A scorer that leaves a file for each key that it is asked for."""
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)

    def score(frame: pd.DataFrame) -> pd.Series:
        for k in frame["scode"]:
            with open(f"{folder}/{k}-{uuid.uuid4().hex}", "w"):
                pass
        return frame["scode"].astype(int) * 1.5

    def asked():
        return sorted(f.split("-")[0] for f in os.listdir(folder))

    return score, asked


def test_each_key_is_scored_once(spark, tmp_path):
    score, asked = counting(str(tmp_path / "asked"))
    for keys in ([1, 2, 3, 3], [2, 3, 4], [4, 1], []):
        rows = spark.createDataFrame([(str(k), k) for k in keys] + [(None, 0)], "scode string, x int")
        found = memo.memoized_scores(rows, ["scode"], "up", score, str(tmp_path / "memo")).collect()
        assert sorted((r.scode, r.score) for r in found if r.scode) == sorted((str(k), k * 1.5) for k in keys) and [r.score for r in found if r.scode is None] == [None]
    assert asked() == ["1", "2", "3", "4"]
    memo.memoized_scores(spark.createDataFrame([("1", 1)], "scode string, x int"), ["scode"], "down", score, str(tmp_path / "memo")).count()
    assert asked() == ["1", "1", "2", "3", "4"]


def test_heads_follow_the_scores(spark):
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(3)}", f"{i:03}", rng.choice([None, rng.random(), 0.5])) for i in range(120)]
    head = None
    for at in range(0, 120, 30):
        part = spark.createDataFrame(rows[at : at + 30], "day string, scode string, score double")
        head = memo.merged_head(head, part, 7, ["day"], ["day", "scode"])
        whole = memo.merged_head(None, spark.createDataFrame(rows[: at + 30], "day string, scode string, score double"), 7, ["day"], ["day", "scode"])
        assert sorted(map(tuple, head.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_failing_batches_halve(spark, tmp_path):
    bad, folder = {"i007", "i040"}, str(tmp_path / "calls")

    def ask(items):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(" ".join(items))
        if bad.intersection(items):
            raise RuntimeError("no answer")
        return [[i, i.upper()] for i in items]

    def calls():
        import os

        return [open(f"{folder}/{f}").read().split() for f in os.listdir(folder)]

    items = spark.createDataFrame([(f"i{i:03}",) for i in range(64)] + [("i001",), (None,)], "item string")
    found = {r.item: r for r in memo.answered(items, ask, str(tmp_path / "answers"), 16, lambda i: ["counted"]).collect()}
    assert len(found) == 64 and all(found[f"i{i:03}"].answer == [f"i{i:03}", f"I{i:03}"] for i in range(64) if f"i{i:03}" not in bad)
    assert all(found[b].answer == ["counted"] and found[b].calls <= 5 for b in bad)  # 16, 8, 4, 2, 1
    first = len(calls())
    assert first <= 64 // 16 + 64 + 2 * 8
    more = spark.createDataFrame([("i001",), ("i007",), ("new",)], "item string")
    again = {r.item: r.answer for r in memo.answered(more, ask, str(tmp_path / "answers"), 16).collect()}
    assert again == {"i001": ["i001", "I001"], "i007": ["counted"], "new": ["new", "NEW"]} and len(calls()) == first + 1
    assert memo.answered(items.where("false"), ask, str(tmp_path / "none")).count() == 0


def test_lines_have_their_numbers(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rng = random.Random(2)
    (tmp_path / "in").mkdir()
    broken = []
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for i in range(1, 401):
            kind = rng.random()
            lines.append("" if kind < 0.1 else '{"k": %d' % i if kind < 0.14 else json.dumps({"k": i, "pad": "x" * rng.randrange(60)}))
            if lines[-1] and not lines[-1].endswith("}"):
                broken.append((name, i))
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        rows = store.numbered_lines(spark, str(tmp_path / "in"))
        assert rows.rdd.getNumPartitions() > 1 and rows.count() == 800
        assert sorted((r.file, r.number) for r in store.broken_lines(spark, str(tmp_path / "in"), "k int").collect()) == sorted(broken)
        with pytest.raises(ValueError, match=f"{broken[0][0]}:{broken[0][1]}$"):
            store.checked_jsonl(spark, str(tmp_path / "in"), "k int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "good.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert sorted(r.k for r in store.checked_jsonl(spark, str(tmp_path / "good.jsonl"), "k int").collect() if r.k) == [1, 2]


def test_failing_sources_are_told(spark):
    schema = "news_link string, title string, summary string, source_name string, publish_time string, credibility_level int, heat long"
    one = spark.createDataFrame([("l1", "AI 芯片", "", "one", "2026-01-01", 2, 5), ("l2", "银行", "", "one", "2026-01-03", 2, 1)], schema)
    two = spark.createDataFrame([("l1", "later", "", "two", "2026-02-01", 3, 99), ("l3", "AI", "", "two", "2026-01-02", 3, None)], schema)

    def gone():
        raise OSError("no answer\nat all")

    rows, failures = news.crawl_sources({"one": lambda: one, "gone": gone, "broken": lambda: two.selectExpr(*two.columns[:-1], "cast(raise_error('bad row') as bigint) as heat"), "two": lambda: two})
    found = rows.collect()
    assert [(r.news_link, r.source_name) for r in found] == [("l2", "one"), ("l3", "two"), ("l1", "one")] and sorted(failures) == ["broken", "gone"] and failures["gone"] == "OSError: no answer"
    assert {c.concept: c.heat for r in found for c in r.concept_heat}["AI"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="no source"):
        news.crawl_sources({"gone": gone})


def plain_cooldown(events, days, gap):
    kept = []
    for s in {s for s, _ in events}:
        index = {d: i for i, d in enumerate(sorted(x for k, x in days if k == s))}
        at, last = None, None
        for d in sorted({d for k, d in events if k == s}):
            if d in index:
                if at is not None and index[d] - at <= gap:
                    continue
                at = index[d]
            elif last is not None and (d - last).days <= gap:
                continue
            else:
                at = None
            last = d
            kept.append((s, d))
    return sorted(kept)


def test_cooldown_without_bars(spark):
    rng = random.Random(3)
    day = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)
    days = [(s, day(i)) for s in "ab" for i in range(120) if rng.random() < 0.6]
    events = [(s, day(i)) for s in "abc" for i in range(120) if rng.random() < 0.3]
    found = datasets.event_cooldown(spark.createDataFrame(events, "scode string, anchor_date date"), spark.createDataFrame(days, "scode string, trade_date date"), 5)
    assert sorted((r.scode, r.anchor_date) for r in found.collect()) == plain_cooldown(events, days, 5)


def test_splits_and_their_manifest(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(str(i), i % 3, "é") for i in range(50)], "scode string, label int, text string")
    rows.write.parquet(str(tmp_path / "rows"))
    assert run.main(["split", "--rows", str(tmp_path / "rows"), "--keys", "scode", "--seed", "7", "--out", str(tmp_path / "out")], spark) == 0
    told = json.loads(capsys.readouterr().out)
    parts = {name: spark.read.json(str(tmp_path / "out" / name)) for name in ("train", "eval")}
    assert told["eval"]["rows"] == parts["eval"].count() == 10 and told["train"]["rows"] == parts["train"].count() == 40
    assert sum(told["train"]["labels"].values()) == 40 and json.loads(spark.read.text(str(tmp_path / "out" / "manifest")).first()[0]) == told
    assert parts["train"].select("scode").union(parts["eval"].select("scode")).distinct().count() == 50


def test_a_gate_ends_with_a_code(spark, tmp_path, capsys):
    spark.createDataFrame([(str(i), int(i < 5), 1.0 - i / 20) for i in range(20)], "scode string, label int, score double").write.parquet(str(tmp_path / "rows"))
    asked = ["evaluate", "--rows", str(tmp_path / "rows"), "--top", "10", "--least"]
    assert run.main([*asked, "precision=0.5,recall=1"], spark) == 0 and run.main([*asked, "precision=0.51"], spark) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[0])["precision"] == 0.5

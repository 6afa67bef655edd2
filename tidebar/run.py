"""Command line: run a strategy, import CSV files, backtest, run a registered query. Tables are those of sources.store.

    python -m tidebar.run select --bars TABLE --stocks PARQUET --strategy ma_bullish_v1 --day 2000-06-15 --limit 20
    python -m tidebar.run import --csv FOLDER --table TABLE
    python -m tidebar.run backtest --bars TABLE --strategy weekly_volume_drop_v1 --start 2000-01-01 --end 2000-12-31 --out FOLDER
    python -m tidebar.run query --name bars_daily --data FOLDER --out FOLDER
    python -m tidebar.run mine --bars TABLE --start 2000-01-01 --end 2000-12-31 --size 4 --support 50 --rate 0.3 --out FOLDER
    python -m tidebar.run split --rows PARQUET --keys scode,trade_date --seed 7 --out FOLDER
    python -m tidebar.run evaluate --rows PARQUET --least precision=0.3,recall=0.1 --top 20

`evaluate` ends with code 1 where a metric misses its bound. `select` takes --news and --patterns (Parquet) for the strategies that need them.
"""

from __future__ import annotations

import argparse
import json
import re
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidebar.operators import backtest, bars, datasets, features, labels, metrics, patterns, scans, signals
from tidebar.sources import raw, store

SETTING = re.compile(r"""^\s*(?:\$env:)?\s*(?P<key>[^#\s=][^=]*?)\s*=\s*(?P<quote>['"]?)(?P<value>.*?)(?P=quote)\s*;?\s*$""", re.IGNORECASE)


def settings(text: str) -> dict[str, str]:
    """Lines such as $env:KEY='value' or KEY=value as a dictionary; comments and other lines are skipped, the last of a key counts."""
    return {m["key"]: m["value"] for line in text.removeprefix("\ufeff").splitlines() if (m := SETTING.match(line))}


def dataset_paths(text: str) -> tuple[str, str]:
    """The folders of training and evaluation that a report names. A report may have its training key twice; the second then is the evaluation's.

    Paths with a drive letter are given as they are mounted under /mnt.
    """
    found: dict[str, list[str]] = defaultdict(list)

    def gather(pairs: list[tuple[str, object]]) -> None:
        for key, value in pairs:
            found[key].append(str(value))

    json.loads(text, object_pairs_hook=gather)
    train, held = found["original_train_dataset_path"], found["original_eval_dataset_path"] or found["original_train_dataset_path"][1:]
    if not train or not held:
        raise ValueError("the report names no folders of training and evaluation")
    return _mounted(train[0]), _mounted(held[-1])


def _mounted(path: str) -> str:
    drive = re.match(r"([A-Za-z]):[\\/]", path)
    return f"/mnt/{drive[1].lower()}/{path[3:]}".replace("\\", "/") if drive else path


def newest(spark: SparkSession, pattern: str) -> str:
    """The text of the file that was changed last among those that match a pattern; ties by path."""
    rows = spark.read.option("wholetext", "true").text(pattern).select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p"))
    found = rows.orderBy(F.desc("t"), F.desc("p")).first()
    if found is None:
        raise FileNotFoundError(pattern)
    return found["value"]


def _bars(spark: SparkSession, path: str):
    daily = store.read_table(spark, path)
    last = daily.agg(F.max("trade_date").cast("string")).first()[0]
    return daily, bars.resample(daily, "W", last)


def evaluate(rows, least: dict[str, float], top: int) -> int:
    """Print precision and recall of the `top` rows by score (label, score); 0 if all bounds are met, else 1."""
    best = rows.orderBy(F.desc_nulls_last("score"), *[c for c in rows.columns if c not in ("score", "label")]).limit(top)
    right = best.agg(F.sum("label").alias("hits"), F.count("*").alias("n")).crossJoin(rows.agg(F.sum("label").alias("all")))
    report = right.select((F.col("hits") / F.greatest("n", F.lit(1))).alias("precision"), (F.col("hits") / F.greatest("all", F.lit(1))).alias("recall"), F.col("n").alias("rows"))
    found = metrics.gate(report, least).first().asDict()
    print(json.dumps(found))
    return 0 if found["passed"] else 1


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidebar", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    wanted = {
        "select": ("bars", "stocks", "strategy", "day"), "import": ("csv", "table"), "backtest": ("bars", "strategy", "start", "end", "out"), "query": ("name", "data", "out"),
        "mine": ("bars", "start", "end", "size", "support", "rate", "out"), "split": ("rows", "keys", "seed", "out"), "evaluate": ("rows", "least"),
    }
    for name, options in wanted.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        if name == "select":
            command.add_argument("--limit", type=int, default=50)
            command.add_argument("--news")
            command.add_argument("--patterns")
        if name == "evaluate":
            command.add_argument("--top", type=int, default=20)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidebar").getOrCreate()
    if args.command == "select":
        stocks = spark.read.parquet(args.stocks)
        inputs = {name: spark.read.parquet(path) for name, path in (("news", args.news), ("patterns", args.patterns)) if path}
        found = signals.strategy_selection(args.strategy, *_bars(spark, args.bars), stocks, day=args.day, **inputs)
        found.where(F.col("trade_date") == F.lit(args.day).cast("date")).limit(args.limit).show(args.limit, truncate=False)
    elif args.command == "import":
        store.upsert(raw.csv_bars(spark, args.csv), args.table, ["scode", "trade_date"], F.date_format("trade_date", "yyyy-MM"))
    elif args.command == "backtest":
        daily, weekly = _bars(spark, args.bars)
        found = signals.run_strategy(args.strategy, daily, weekly)
        outcomes = backtest.evaluate(scans.between(found, args.start, args.end).select("scode", "trade_date", "close"), daily)
        for name, rows in (("summary", backtest.summary(outcomes)), ("by_stock", backtest.by_stock(outcomes)), ("by_selection", backtest.by_selection(outcomes))):
            store.write_csv(rows, f"{args.out}/{name}", bom=True)
    elif args.command == "mine":
        daily, weekly = _bars(spark, args.bars)
        rows = features.features(daily, weekly)
        events = labels.surge_events(daily, args.start, args.end).select("scode", F.col("selection_date").alias("trade_date"))
        patterns.mined(rows, events, patterns.token_vocabulary(rows), int(args.size), int(args.support), tuple(patterns.rate_list(args.rate))).drop("code").write.mode("overwrite").parquet(args.out)
    elif args.command == "split":
        print(json.dumps(datasets.write_split(spark.read.parquet(args.rows), args.out, int(args.seed), args.keys.split(","))))
    elif args.command == "evaluate":
        return evaluate(spark.read.parquet(args.rows), {k: float(v) for k, v in (pair.split("=") for pair in args.least.split(","))}, args.top)
    else:
        from tidebar.plans import extra_queries, family_queries, mining_queries  # noqa: F401
        from tidebar.plans.queries import QUERIES

        QUERIES[args.name](spark, args.data).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

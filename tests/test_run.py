"""The command line and the small files that it reads."""

import pytest

from tidebar import run
from tidebar.sources import store


def test_settings_and_reports(spark, tmp_path):
    assert run.settings("\ufeff# none\n$env:A='x=1';\nB = \"two\"\nC=3 ;\nnothing\n=4\nA='last'") == {"A": "last", "B": "two", "C": "3"}
    twice = '{"original_train_dataset_path": "C:\\\\data\\\\t", "n": 1, "original_train_dataset_path": "/e"}'
    assert run.dataset_paths(twice) == ("/mnt/c/data/t", "/e")
    assert run.dataset_paths('{"original_train_dataset_path": "t", "original_eval_dataset_path": "e"}') == ("t", "e")
    with pytest.raises(ValueError):
        run.dataset_paths('{"original_train_dataset_path": "t"}')
    (tmp_path / "eval-1.json").write_text("one")
    assert run.newest(spark, f"{tmp_path}/eval-*.json") == "one"


def test_import_select_backtest(spark, tmp_path, capsys):
    lines = ["code,date,open,close,high,low,vol,amount"]
    for i in range(90):
        lines.append(f"1,2026-{1 + i // 28:02}-{1 + i % 28:02},{10 + i * 0.02 - 0.01},{10 + i * 0.02},{10 + i * 0.02 + 0.1},{10 + i * 0.02 - 0.1},1000,{100 + i}")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("\n".join(lines))
    table = str(tmp_path / "bars")
    for _ in range(2):
        assert run.main(["import", "--csv", str(tmp_path / "csv"), "--table", table], spark) == 0
        assert store.read_table(spark, table).count() == 90
    spark.createDataFrame([("000001", "first")], "scode string, sname string").write.parquet(str(tmp_path / "stocks"))
    run.main(["select", "--bars", table, "--stocks", str(tmp_path / "stocks"), "--strategy", "ma_bullish_v1", "--day", "2026-03-20"], spark)
    assert "first" in capsys.readouterr().out
    run.main(["backtest", "--bars", table, "--strategy", "ma_bullish_v1", "--start", "2026-03-01", "--end", "2026-04-30", "--out", str(tmp_path / "out")], spark)
    summary = spark.read.option("header", "true").csv(str(tmp_path / "out" / "summary")).first()
    assert int(summary[0]) > 0

"""Queries of this subpackage that have SQL, against DuckDB on the smallest tables, and over nulls, repeats and odd texts."""

import duckdb
import pytest

from tidebar.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark")


def same(spark, folder, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if folder == DATA else '/*.parquet'}'")
        df = queries.queries()[name](spark, folder)
        columns = sorted(df.columns)
        found = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert len(c.execute(f"DESCRIBE {queries.oracle_sql()[name]}").fetchall()) == len(columns)
    assert sorted(tuple(map(str, (r[k] for k in columns))) for r in df.collect()) == sorted(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    same(spark, DATA, name)


@pytest.mark.parametrize("name", ["op2_jump_shards", "op10_size_aware_jaccard"])
def test_odd_rows_same_as_sql(spark, tmp_path, name):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t", "one", "One", "two words", base, base.upper(), f"{base} more", f"first {base}", base + " and so on to a longer end of it", "é ß 中文 字 и", "x" * 3000]
    rows = [(i - 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for t in TABLES[1:]:
        spark.createDataFrame([], "id long").write.parquet(str(tmp_path / f"{t}.parquet"))
    same(spark, str(tmp_path), name)

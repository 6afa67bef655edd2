"""Tables and files on shared storage: upsert by natural key, replacement of slices, lines of JSON, CSV, manifests.

An upserted table is a folder of Parquet folders and a log. An entry of the log names, for each part of the table, the folder that holds it; it appears
by one rename, so readers see the table before an upsert or after it, and a crash at any time leaves the last whole entry in force.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a table that is divided by a hash of its keys.
PARTS = 64


def merged(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows and the stored ones whose key is not among them; null keys match null keys."""
    fresh = incoming.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same: Column = F.lit(True)
    for k in keys:
        same = same & stored[k].eqNullSafe(fresh[f"__{k}"])
    return stored.join(fresh, same, "left_anti").unionByName(incoming, allowMissingColumns=True)


def last_of_each(incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row for each key: the first in the given order, and by all other columns from the greatest on where that does not decide."""
    rest = [F.col(f.name).desc() for f in incoming.schema.fields if f.name not in keys and f.dataType.typeName() != "map"]
    w = Window.partitionBy(*keys).orderBy(*order, *rest) if order or rest else None
    return incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n") if w else incoming.dropDuplicates(list(keys))


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def _entries(spark: SparkSession, path: str) -> list[int]:
    fs, log = _fs(spark, f"{path}/_log")
    names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _entry(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    fs, file = _fs(spark, f"{path}/_log/{number:012}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, number: int, folders: dict[str, str]) -> None:
    fs, draft = _fs(spark, f"{path}/_log/{number:012}-{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    _, file = _fs(spark, f"{path}/_log/{number:012}.json")
    if fs.exists(file) or not fs.rename(draft, file):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has made entry {number} of {path}")


def table_exists(spark: SparkSession, path: str) -> bool:
    return bool(_entries(spark, path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an upserted table, as of its last entry."""
    numbers = _entries(spark, path)
    if not numbers:
        raise FileNotFoundError(path)
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{f}" for f in sorted(_entry(spark, path, numbers[-1]).values())])


def upsert(incoming: DataFrame, path: str, keys: Sequence[str], by: Column | None = None, order: Sequence[Column] = ()) -> None:
    """Rows of a table replaced or added by key. Twice the same input leaves the same table.

    Only parts of the table that the input touches are read and written: parts by the text of `by` (such as a month; it must follow from the key, and a
    table keeps its rule) or by a hash of the key. Of rows that repeat a key in the input one stays, see last_of_each(). The last two entries of the log
    keep their folders, for readers that are still at work; older ones go.
    """
    spark, path = incoming.sparkSession, path.rstrip("/")
    part = F.regexp_replace(F.coalesce(by.cast("string"), F.lit("none")), "[^A-Za-z0-9_-]", "_") if by is not None else F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("string")
    fresh = last_of_each(incoming, keys, order).withColumn("__part", part)
    numbers = _entries(spark, path)
    folders = _entry(spark, path, numbers[-1]) if numbers else {}
    touched = sorted(r[0] for r in fresh.select("__part").distinct().collect())
    if numbers and not touched:
        return
    old = [f"{path}/{folders[p]}" for p in touched if p in folders]
    whole = merged(spark.read.option("mergeSchema", "true").parquet(*old).withColumn("__part", part), fresh, keys) if old else fresh
    name = f"data-{uuid.uuid4().hex}"
    if touched:
        whole.repartition("__part").write.partitionBy("__part").parquet(f"{path}/{name}")
        now = folders | {p: f"{name}/__part={p}" for p in touched}
    else:  # a table without rows still has columns
        fresh.drop("__part").write.parquet(f"{path}/{name}")
        now = {"none": name}
    number = numbers[-1] + 1 if numbers else 1
    _publish(spark, path, number, now)
    _forget(spark, path, {*now.values(), *folders.values()}, number - 1)


def _forget(spark: SparkSession, path: str, used: set[str], least: int) -> None:
    """Delete entries before `least` and folders that no later one uses."""
    for n in _entries(spark, path):
        if n >= least:
            continue
        for folder in set(_entry(spark, path, n).values()) - used:
            fs, target = _fs(spark, f"{path}/{folder}")
            fs.delete(target, True)
        fs, file = _fs(spark, f"{path}/_log/{n:012}.json")
        fs.delete(file, False)


def replace_slices(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Delete and insert by key slice: the partitions that rows touch are overwritten, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """Lines of JSON; a broken one raises an error when it is read, or is all nulls if not strict. limit: that many lines at most."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return rows.limit(limit) if limit is not None else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1) and line of every line of text files, blank ones too.

    Large files are read in blocks by many tasks: the lines of each block are counted, the counts of the blocks before it are added up, and a line's place in
    its block comes from its place in its task. The table of blocks has a row for each 128 MB or so.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    blocks = lines.groupBy("path", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("number"), "line")


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, number and line of what read_jsonl cannot parse; blank lines are skipped."""
    parsed = F.from_json("line", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return numbered_lines(spark, path).where("trim(line) <> ''").where(parsed["_broken"].isNotNull())


def checked_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; raises ValueError that names the file and the line of the first broken one."""
    first = broken_lines(spark, path, schema).orderBy("file", "number").first()
    if first is not None:
        raise ValueError(f"invalid JSON at {first.file}:{first.number}")
    return spark.read.schema(schema).json(path)


def write_csv(rows: DataFrame, path: str, bom: bool = False, append: bool = False) -> None:
    """CSV with a header line in each file; bom: files begin with the byte order mark that spreadsheets look for. append: earlier files stay."""
    out = rows.withColumnRenamed(rows.columns[0], f"\ufeff{rows.columns[0]}") if bom else rows
    out.write.mode("append" if append else "overwrite").option("header", "true").csv(path)


def master_list(providers: Sequence[DataFrame]) -> DataFrame:
    """scode and sname of the first provider that has any row; symbols normalized, each once (the least name), in order."""
    from tidebar.functions.scalars import normalize_symbol

    for rows in providers:
        listed = rows.select(normalize_symbol(F.col("scode")).alias("scode"), F.trim("sname").alias("sname")).where("scode IS NOT NULL")
        if listed.take(1):
            return listed.groupBy("scode").agg(F.min("sname").alias("sname")).orderBy("scode")
    raise ValueError("no provider has a stock")


def manifest(row: DataFrame) -> str:
    """A one-row result as JSON."""
    return json.dumps(row.first().asDict(recursive=True), ensure_ascii=False, default=str, sort_keys=True)

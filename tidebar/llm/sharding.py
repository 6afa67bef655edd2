"""Sharding by jump consistent hashing, in DataFrame functions only.

The key is the integer doc_id as an unsigned 64-bit number. The generator is the linear congruential one of the published algorithm;
its products need up to 126 bits, so the state is kept as DECIMAL(38,0), which holds them exactly (ANSI mode raises on a BIGINT overflow).
No ring table and no state: a shard follows from doc_id and the shard count alone, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, scratch_name, table

#: Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648


def jump_expr(key: str, shards: int) -> str:
    """SQL for the shard (0 .. shards-1) of an integer column; a null key counts as 0.

    The candidate j grows with every step, so `shards` steps always suffice.
    """
    step = f"""named_struct(
        'k', CAST((s.k * {MULTIPLIER}BD + 1BD) % {TWO_64}BD AS DECIMAL(38,0)),
        'b', s.j,
        'j', CAST(floor((s.j + 1) * ({TWO_31}D / CAST(((s.k * {MULTIPLIER}BD + 1BD) % {TWO_64}BD) DIV {TWO_33}BD + 1 AS DOUBLE))) AS BIGINT))"""
    start = f"CAST(pmod(CAST(coalesce({key}, 0) AS DECIMAL(38,0)), {TWO_64}BD) AS DECIMAL(38,0))"
    return f"""CAST(aggregate(sequence(1, {shards}), named_struct('k', {start}, 'b', -1L, 'j', 0L),
        (s, i) -> if(s.j < {shards}, {step}, s), s -> if(s.j < {shards}, s.j, s.b)) AS INT)"""


def assign(df: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with its shard. No shuffle; nulls share the key 0; repeated rows go to one shard; an existing column `out` is replaced."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    return df.withColumn(out, F.expr(jump_expr(f"`{key}`", shards)))


def slots(df: DataFrame, shard: str = "shard", key: str = "doc_id", rows_per_bucket: int = 1000, max_buckets: int = 4096) -> DataFrame:
    """df with `slot`, gapless from 0 in each shard.

    Each shard is numbered in buckets of the key's crc32, so no task holds a shard: rank in the bucket, plus the rows of the buckets before it.
    The offsets are one row for each shard and bucket, max_buckets of them per shard at most, and so may be broadcast.
    """
    n = df.count()
    buckets = max(1, min(max_buckets, n // rows_per_bucket))
    bucket, s, b, offset, rank = (scratch_name(df, x) for x in ("bucket", "s", "b", "offset", "rank"))
    bucketed = df.withColumn(bucket, F.crc32(id_text(key)) % F.lit(buckets))
    counts = bucketed.groupBy(F.col(shard).alias(s), F.col(bucket).alias(b)).agg(F.count("*").alias(rank))
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(s, b, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(offset))
    ranked = bucketed.withColumn(rank, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(key)))
    joined = ranked.join(F.broadcast(offsets), (F.col(shard) == F.col(s)) & (F.col(bucket) == F.col(b)))
    return joined.withColumn("slot", (F.col(offset) + F.col(rank) - 1).cast("long")).drop(s, b, offset, rank, bucket)


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op2: law `key`, 8 shards, 9 when grown. A null text has the size 1 and the crc32 of no bytes, 0."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, 8), 9, out="grown_shard")
    return slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op2_jump_shards": op2_jump_shards}


# CRC-32 as SQL: the remainder of each byte by eight steps, then one step for each byte of a text in hexadecimal.
_STEP = "CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END"


def _crc32_sql(hexed: str) -> str:
    numbers = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce({numbers}, lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


ORACLE_SQL = {
    "op2_jump_shards": f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS byte, i::BIGINT AS r, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT byte, {_STEP}, step + 1 FROM bits WHERE step < 8),
tbl AS (SELECT list(r ORDER BY byte) AS rest FROM bits WHERE step = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
jump AS (
  SELECT r, n, (coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN {TWO_64} ELSE 0 END)::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT r, n, k, j, floor((j + 1) * ({TWO_31}::DOUBLE / ((k // {TWO_33}::UHUGEINT)::DOUBLE + 1)))::BIGINT
  FROM (SELECT r, n, j, (k * {MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % {TWO_64}::UHUGEINT AS k FROM jump WHERE j < n)),
placed AS (SELECT r, max(b) FILTER (n = 8)::INTEGER AS shard, max(b) FILTER (n = 9)::INTEGER AS grown_shard FROM jump WHERE j >= n GROUP BY r),
coded AS (
  SELECT r, doc_id, octet_length(encode(t)) + 1 AS size, {_crc32_sql("hex(encode(t))")} AS text_crc32,
    {_crc32_sql("hex(encode(coalesce(doc_id::VARCHAR, '')))")} % greatest(1, least(4096, count(*) OVER () // 1000)) AS bucket FROM d, tbl)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, grown_shard
FROM coded JOIN placed USING (r)""",
}

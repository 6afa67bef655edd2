"""Packing into fixed windows by minimum bin slack.

Documents longer than a window are cut into full windows and a rest. How many pieces have each length is one bounded table (a row per length
up to the window), so the whole plan is made from counts: the longest remaining length opens a window, a bitset subset-sum dynamic program
over the remaining multiset finds the fill closest to capacity, backtracking gives how many pieces of each length it takes, and the pattern is
used as often as the counts allow. The plan has a few rows for each length, whatever the number of documents. Pieces find their window by
their rank among the pieces of their length; ranks are counted in buckets, so a length that a third of all pieces share stays spread out.

Edge cases: a null or empty text is the end token alone; repeated rows are packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import id_text, slices, stored, table

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length that a bucket, in which they are ranked, holds on average.
PIECES_PER_BUCKET = 20_000


_Packed = bpe.Packed


def pieces(df: DataFrame, path: str, lexicon: bytes, window: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, length, ids_crc32 and doc_tokens of each piece: full windows and the rest. No shuffle, and no ids leave the task."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    names = [key, *(x.split()[0] for x in PIECES.split(", "))]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_for(path, shared.value, _Packed(), bpe.PackedEncoder)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * window
        for batch in slices(batches, 4000):
            row, start, length, crc, total = [], [], [], [], []
            texts = (ids[a:b] for ids, ends in encoder.columns(batch.column(1)) for a, b in zip(ends, ends[1:]))
            for i, ids in enumerate(texts):
                data = memoryview(b"".join([ids, end]))
                for at in range(0, len(data), step):
                    cut = data[at : at + step]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    total.append(len(data) // 4)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(key, text).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill `capacity` best: bit s of a bitset says that the sum s can be had from the lengths so far.

    Copies of a length are added by doubling. The program stops at the first length with which the capacity is met exactly; else the
    highest bit wins, and each step backwards takes the fewest copies that explain the sum.
    """
    mask, reach, steps = (2 << capacity) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        steps.append((length, reach))
        left, block = min(counts[length], capacity // length), 1
        while left:
            use = min(block, left)
            reach |= reach << (use * length) & mask
            left -= use
            block *= 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> (total - copies * length) & 1:
            copies += 1
        if copies:
            taken[length] = copies
        total -= copies * length
    return taken


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, pieces in a window, first sequence, offset): which windows take which pieces of each length."""
    left, used, rows, sequence = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest({k: n for k, n in left.items() if n}, window - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for k, n in sorted(taken.items(), reverse=True):
            rows.append((k, used[k], used[k] + times * n, n, sequence, offset))
            offset += n * k
            used[k] += times * n
            left[k] -= times * n
            if not left[k]:
                del left[k]
        sequence += times
    return rows


def pack(found: DataFrame, window: int = 2048, key: str = "doc_id") -> DataFrame:
    """Pieces (a `length` each, window at most) with their sequence_id and offset. `found` is read twice and should be stored."""
    spark = found.sparkSession
    totals = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # a row for each length up to the window
    sizes = spark.createDataFrame([(k, -(-n // PIECES_PER_BUCKET)) for k, n in totals.items()], "__sl long, __buckets long")
    bucketed = found.join(F.broadcast(sizes), F.col("length") == F.col("__sl")).withColumn("__bucket", F.pmod(F.xxhash64(id_text(key), "start"), F.col("__buckets")))
    counts = stored(bucketed.groupBy("length", "__bucket").count(), "buckets")
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rows = plan(totals, window)
    planned = spark.createDataFrame(rows, "__pl long, __first long, __end long, __n long, __sequence long, __at long")
    ranked = bucketed.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(key, "start")))
    # offsets have a row for each bucket of a length, fewer than one for 20,000 pieces and one for each length; Spark chooses how they are joined
    ranked = ranked.join(offsets, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__r") - 1)
    placed = ranked.join(F.broadcast(planned), (F.col("length") == F.col("__pl")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    along = F.col("__rank") - F.col("__first")
    return placed.select(*found.columns, (F.col("__sequence") + F.floor(along / F.col("__n"))).cast("long").alias("sequence_id"), (F.col("__at") + (along % F.col("__n")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = 2048) -> DataFrame:
    """Documents to placed pieces. The lexicon holds the vocabulary's whole words; other words are merged, so no pass counts the corpus."""
    path = path or bpe.tokenizer_path()
    return pack(stored(pieces(docs, path, bpe.lexicon_for(path), window), "pieces"), window)


def op9_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op9: windows of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op9_slack_packing": op9_slack_packing}

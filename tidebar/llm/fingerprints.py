"""Document fingerprints by locally consistent parsing.

A text is a string of symbols, its code points. On each level, runs of one symbol become one symbol, and deterministic coin tossing labels every
symbol by the lowest bit in which it differs from its left neighbour and that bit's value; repeated, labels fall below six whatever the
alphabet was. Symbols whose label is a local maximum begin phrases, of two symbols or more and a few at most; a phrase is named by a hash
of its symbols, and names are the symbols of the next level. Where a phrase begins depends on a few neighbours only, so equal substrings
have the same phrases inside, at whatever offset they stand.

The fingerprint is a one-permutation minwise sketch of the distinct phrase names of levels 2 and 3, which every text that isn't empty has; the likeness
of two is the share of slots on which they agree, among those that either fills. A phrase of level 2 has about 8 characters, so a fingerprint of a
text below some 100 characters has few names, and one edit shows in it more.

Edge cases: null and empty texts have no phrases; their fingerprints are equal, and so their likeness is 1. Rows without a doc_id come first
in the order of documents; rows that repeat a doc_id are ordered by their text; the one row of a table is its own next one; an empty table gives
an empty result. fingerprints() keeps other columns and replaces one named like its output; compared() returns its own columns alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Slots of a sketch, and bits of each.
SLOTS, SLOT_BITS = 128, 16
#: Stretches of doc_id for each shuffle partition, so that partitions, which get them by hash, are near equal.
STRETCHES = 4
#: Levels whose names are sketched.
LEVELS = (2, 3)
#: Rounds of coin tossing: 64-bit names fall below 128, 14, 8 and 6.
ROUNDS = 4
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX
    return x ^ (x >> np.uint64(31))


def coin_labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six of symbols without equal neighbours; `first` marks the beginnings of texts. After the first round a label fits into a byte."""
    labels = symbols
    for _ in range(ROUNDS):
        one = labels.dtype.type(1)
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[first] = labels[first] ^ one
        before ^= labels
        lowest = before & (~before + one)
        place = np.bitwise_count(lowest - one)
        labels = (place << np.uint8(1)) | ((labels & lowest) != 0)
    return labels


def phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of texts that stand one after the other, and which names begin a text."""
    if not len(symbols):
        return symbols, first
    # runs of a symbol become one symbol that knows its length
    starts = first.copy()
    starts[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(starts)
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols, first = symbols[at], first[at]
        many = length > 1
        symbols = symbols.astype(np.uint64)
        symbols[many] = mixed(symbols[many] * MIX + length[many])
        equal = np.flatnonzero((symbols[1:] == symbols[:-1]) & ~first[1:]) + 1
        symbols[equal] += ONE
    labels = coin_labels(symbols, first)
    last = np.append(first[1:], True)
    left = np.zeros(len(labels), dtype=bool)
    left[1:] = labels[1:] > labels[:-1]
    right = np.zeros(len(labels), dtype=bool)
    right[:-1] = labels[:-1] > labels[1:]
    begins = left & right & ~last
    begins |= first
    at = np.flatnonzero(begins)
    sizes = np.diff(np.append(at, len(symbols)))
    names = np.full(len(at), 0x51ED270B, dtype=np.uint64)
    live = np.arange(len(at))
    for i in range(int(sizes.max())):
        live = live[sizes[live] > i]
        names[live] = names[live] * MIX + symbols[at[live] + i]
        names[live] ^= names[live] >> np.uint64(32)
    return mixed(names), first[at]


def sketches(texts: list[str]) -> list[str]:
    """Fingerprints of texts: slots in hexadecimal, `-` for each that is not filled."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    symbols = np.concatenate(codes) if texts else np.empty(0, np.uint32)
    first = np.zeros(len(symbols), dtype=bool)
    full = np.flatnonzero(sizes)
    first[(np.cumsum(sizes) - sizes)[full]] = True
    best = np.full((len(texts), SLOTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for level in range(1, max(LEVELS) + 1):
        symbols, first = phrases(symbols, first)
        if level in LEVELS and len(symbols):
            owner = full[np.cumsum(first) - 1]
            names = mixed(symbols * MIX + np.uint64(level))
            slot = owner * SLOTS + (names % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(best.reshape(-1), slot, names >> np.uint64(7))
    out = []
    for row in best:
        empty = row == np.iinfo(np.uint64).max
        values = (row & np.uint64((1 << SLOT_BITS) - 1)).tolist()
        out.append(" ".join("-" if e else f"{v:x}" for e, v in zip(empty.tolist(), values)))
    return out


def likeness(a: str, b: str) -> float:
    """Share of slots that agree among those that are filled in either; 1 for two empty ones."""
    x, y = a.split(" "), b.split(" ")
    either = sum(p != "-" or q != "-" for p, q in zip(x, y))
    return sum(p == q != "-" for p, q in zip(x, y)) / either if either else 1.0


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of the whole text; no shuffle."""
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for part in in_pieces(batch.column(text).to_pylist()) for s in sketches([t or "" for t in part])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(found, pa.string())], names=[*kept, out])

    return docs.mapInArrow(run, docs.select(kept).schema.add(out, "string"))


def in_pieces(texts: list, characters: int = 400_000) -> Iterator[list]:
    """The list cut into parts of so many characters or one text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > characters:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def bounds_up_to(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: counted among the heads of blocks, then in one block."""
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    full = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda b: b <= value))
    block = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), full - 1)
    return F.when(full > 0, (full - 1) * step + F.size(F.filter(block, lambda b: b <= value))).otherwise(0)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (stretch, ghost, id, t) such that in each stretch, ordered by (ghost, id, t), each row's next document is the row after it.

    Keys are cut into stretches at quantiles (which need not be exact), so texts are shuffled once and no task sorts the table.
    The ghost that ends a stretch is a copy of the first document of the next stretch that has rows, or of the first of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tasks = STRETCHES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(x) for x in rows.where("id IS NOT NULL").approxQuantile("id", [i / tasks for i in range(1, tasks)], 0.1 / tasks)}) if tasks > 1 else []
    stretch = F.lit(0)
    if bounds:
        stretch = F.coalesce(F.when(F.col("id").isNotNull(), bounds_up_to(F.col("id"), bounds)), F.lit(0))
    placed = rows.withColumn("stretch", stretch.cast("int"))
    # one row for each stretch: its first document
    firsts = sorted(r["stretch"] for r in placed.groupBy("stretch").agg(F.count("*").alias("n")).collect())
    if not firsts:
        return placed.select("stretch", F.lit(0).alias("ghost"), "id", "t")
    before = {now: firsts[i - 1] for i, now in enumerate(firsts)}
    goes_to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    least = placed.groupBy("stretch").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("none"))
    heads = placed.join(F.broadcast(least.withColumnRenamed("stretch", "s")), F.col("stretch") == F.col("s")).where(F.when(F.col("none"), F.col("id").isNull()).otherwise(F.col("id") == F.col("first")))
    ghosts = heads.groupBy("stretch", "id").agg(F.min("t").alias("t")).select(goes_to[F.col("stretch")].alias("stretch"), F.lit(1).alias("ghost"), "id", "t")
    return placed.select("stretch", F.lit(0).alias("ghost"), "id", "t").union(ghosts)


def compared(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, texts, ghosts = batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("ghost").to_pylist()
            own = [s for part in in_pieces(texts) for s in sketches(part)]
            rows = list(zip(ids, texts, ghosts, own))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1] if rows else last
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2]]
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
            theirs = [s for part in in_pieces(edited) for s in sketches(part)]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([a[0] for a, _ in pairs], batch.schema.field("id").type), "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([a[3] for a, _ in pairs], pa.string()), "edited_fingerprint": pa.array(theirs, pa.string()),
                "near_edited": pa.array([likeness(a[3], f) for (a, _), f in zip(pairs, theirs)], pa.float64()),
                "near_next": pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
            })

    rows = with_next(docs, text, key)
    return rows.repartition("stretch").sortWithinPartitions("stretch", "ghost", F.col("id").asc_nulls_first(), "t").select("id", "t", "ghost").mapInArrow(run, schema)


def op4_parsed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op4."""
    return compared(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_parsed_fingerprints": op4_parsed_fingerprints}

"""Importance resampling towards a target corpus, over bucketed features.

Runs of words are hashed into buckets. Each corpus becomes inverted postings: one row for a bucket and a batch of documents, with the documents'
numbers and counts. Brought together by bucket, the counts of both corpora give the bucket's gain, the log of how much more likely the target
uses it. The postings are shuffled by bucket, in slices whose size does not grow with the corpus, so that a word which nearly all documents have is
dealt over many tasks; there each becomes a contribution, and contributions are summed by document. Documents are drawn with Gumbel noise from a hash of
their id, highest score first, which is sampling without replacement by weight.

Ranks come from one range partitioning by score: a document's place within its partition, and how many rows are in those before it.

Edge cases: a null or wordless text has no features and weight 0; rows that repeat a doc_id are scored each by itself; a null doc_id hashes as an
empty one, and comes last among ties; texts of any length count whole; an empty corpus, or target, counts 0 everywhere; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, scratch_name, slices, stored, table

#: Words of the contract: ASCII letters and digits, and all characters beyond ASCII, after A-Z became small.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text that are split into words at a time, and entries of a worker's memo of buckets.
PART_BYTES = 1 << 20
MEMO_ENTRIES = 400_000
#: Posting rows of a bucket that meet in one slice; each has a batch's documents at most.
SLICE_ROWS = 64


class Buckets(dict):
    """A feature's bucket, by its UTF-8 bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features_of(text: str | None, longest: int = 1) -> Iterator[list[bytes]]:
    """The text's runs of 1 to `longest` words, some at a time, repeats included."""
    raw, at, tail = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(raw):
        gap = GAP.search(raw, at + PART_BYTES)
        end = gap.end() if gap else len(raw)
        words = WORDS.findall(raw, at, end)
        at = end
        yield words
        if longest > 1:
            run = tail + words
            for n in range(2, longest + 1):
                skip = max(0, len(tail) - n + 1)  # runs that end within these words
                yield [b" ".join(x) for x in zip(*(run[skip + i :] for i in range(n)))]
            tail = run[len(run) - longest + 1 :] if len(run) >= longest else run


def postings(df: DataFrame, text: str = "text", key: str = "doc_id", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """Inverted postings of df: bucket, number (of its documents) and count arrays, n (the sum of counts), and for bucket -1 the documents themselves:
    their keys in `ids`, their features in `counts`. A document's number is its task's and its place there."""
    kind = df.schema[key].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType().add("bucket", "integer").add("numbers", longs).add("counts", longs).add("n", "long").add("ids", T.ArrayType(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, memo = TaskContext.get().partitionId() << 33, Buckets(buckets)
        for batch in slices(batches, 2000):
            sizes = np.zeros(batch.num_rows, np.int64)
            found: list[np.ndarray] = []
            for i, value in enumerate(batch.column(1)):
                for words in features_of(value.as_py(), longest):
                    codes = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                    sizes[i] += len(codes)
                    own, times = np.unique(codes, return_counts=True)
                    found.append(np.stack([own, np.full(len(own), i), times]))
            rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            together, place = np.unique(rows[0] * batch.num_rows + rows[1], return_inverse=True)
            times = np.bincount(place, rows[2], len(together)).astype(np.int64)  # counts of a batch, far below 2^53
            bucket, numbers = together // batch.num_rows, together % batch.num_rows + first
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            offsets = np.concatenate([[0], [batch.num_rows], starts[1:] + batch.num_rows, [len(bucket) + batch.num_rows]] if len(bucket) else [[0], [batch.num_rows]]).astype(np.int32)
            none = pa.array([None] * len(starts), pa.list_(batch.schema.field(0).type))
            ids = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), none])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([[-1], bucket[starts]]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.arange(batch.num_rows) + first, numbers]))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([sizes, times]))),
                    pa.array(np.concatenate([[sizes.sum()], np.add.reduceat(times, starts) if len(starts) else []]).astype(np.int64)),
                    ids,
                ],
                names=schema.names,
            )
            first += batch.num_rows

    return df.select(key, text).mapInArrow(run, schema)


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket and gain, from the postings of both corpora brought together by bucket: a row for each bucket that the source has."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(target.select("bucket", F.lit(0).cast("long"), "n"))
    together = stored(both.where("bucket >= 0").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_s, all_t = together.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return together.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weights(source: DataFrame, gain: DataFrame) -> DataFrame:
    """number, doc_id, n_features and weight of each document of the source's postings, which are read twice and should be stored."""
    heads = source.where("bucket = -1")
    n_slices = max(1, -(-heads.count() // SLICE_ROWS))
    dealt = source.where("bucket >= 0").select("bucket", "numbers", "counts", F.pmod(F.xxhash64(F.col("numbers")[0]), F.lit(n_slices)).alias("slice"))
    spread = gain.select("bucket", "gain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long"))).alias("slice"))
    met = dealt.join(spread.hint("shuffle_hash"), ["bucket", "slice"])
    parts = met.select("gain", F.explode(F.arrays_zip("numbers", "counts")).alias("p")).select(F.col("p.numbers").alias("number"), (F.col("p.counts") * F.col("gain")).alias("part"))
    summed = parts.groupBy("number").agg(F.sum("part").alias("weight"))
    each = heads.select(F.explode(F.arrays_zip("numbers", "ids", "counts")).alias("p")).select(F.col("p.numbers").alias("number"), F.col("p.ids").alias("doc_id"), F.col("p.counts").alias("n_features"))
    return each.join(summed, "number", "left").select("number", "doc_id", "n_features", F.coalesce("weight", F.lit(0).cast("long")).alias("weight"))


def noise(seed: int, key: str = "doc_id"):
    """Gumbel noise in thousandths, from the key's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text(key)), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, *order, out: str = "rank") -> DataFrame:
    """df with each row's rank, 1 for the first in `order`, as long. One shuffle by range; the tables of counts have a row for each partition."""
    place = scratch_name(df, "place")
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    kept = stored(sorted_rows, "ranked")
    counts = sorted((r[0], r[1]) for r in kept.groupBy(F.shiftright(place, 33)).count().collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, f"`{place}p` long, `{place}b` long")
    joined = kept.join(F.broadcast(offsets), F.shiftright(place, 33) == F.col(f"{place}p"))
    return joined.select(*df.columns, (F.col(f"{place}b") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(out))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least: int = 20, seed: int = 2024, longest: int = 1, buckets: int = 10_000, target_key: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text): floor(percent * N / 100) of the N documents with `least` features or
    more are drawn, those of the highest score, and have a rank."""
    source = stored(postings(docs, longest=longest, buckets=buckets), "postings")
    wanted = postings(target, key=target_key, longest=longest, buckets=buckets).select("bucket", "n")
    scored = weights(source, gains(source.select("bucket", "n"), wanted, buckets)).withColumn("score", F.col("weight") + noise(seed))
    rows = stored(scored.select("doc_id", "n_features", "weight", "score"), "scored")
    able = F.col("n_features") >= least
    drawn = percent * rows.where(able).count() // 100
    first = ranked(rows.where(able), F.desc("score"), F.asc_nulls_last("doc_id"))
    return first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op12_posting_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op12: documents towards benchmark, single words, 10,000 buckets, a tenth of the documents with 20 words or more."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_posting_resampling": op12_posting_resampling}

# CRC-32 as SQL: the remainder of each byte by eight steps, then one step for each byte of a feature.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384, {0} >> 1) ELSE {0} >> 1 END"
_WORDS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
ORACLE_SQL = {
    "op12_posting_resampling": f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS byte, i::BIGINT AS r, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT byte, {_STEP.format("r")}, step + 1 FROM bits WHERE step < 8),
tbl AS (SELECT list(r ORDER BY byte) AS rest FROM bits WHERE step = 8),
doc_words AS (SELECT doc_id, {_WORDS} AS word FROM documents),
bench_words AS (SELECT {_WORDS} AS word FROM benchmark),
words AS (SELECT word, hex(encode(word)) AS hexed FROM (SELECT DISTINCT word FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM bench_words))),
coded AS (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(0, length(hexed) // 2), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket FROM words, tbl),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bench_words JOIN coded USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
weighed AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM doc_words JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed""",
}

"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends at white space whose last eight bytes have a low gear hash, so chunks are whole words and an insertion only changes the chunks that
it touches. Where no white space lies within the last 64 bytes, as in Chinese or Japanese, it ends between two characters, by another value of the same hash. Chunks that several documents have are found by their 64-bit digests with partial aggregation. A document loses a run of
consecutive chunks if each is also in a document of lesser id and the passage is long enough: short common phrases stay, and so does
what repeats within one document alone. The least document keeps the passage.

Chunks end where their content says, so a passage goes on into the chunks at both ends of its run. A run is extended, by whole words, as far as
it equals the text around the same chunks in a lesser document: the one that is the least for most of its bytes. The length of the extended
passage decides. In text without white space, it is extended by whole characters.

Chunks are told apart by digests of 64 bits. A run of one chunk must have 48 bytes, and what is removed 160 bytes or 50 words, so that only collisions of
long chunks, or of several in a row, could remove what is in one document alone; in 10^11 chunks of 160 bytes and more some 300 pairs are expected.

Edge cases: null texts stay null and empty ones empty; only what the hash leaves whole for 240 bytes, such as one character many times, is cut by
length, between characters; rows that share a doc_id count as one document; a null doc_id takes no part and is left alone; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, scratch_name, stored, table

#: Bytes that the gear hash sees; white space of 16 that ends a chunk; most bytes of a chunk; least bytes of a run that is removed;
#: words of an extended passage that is removed even if its run is shorter; least bytes of a chunk that is a run alone.
WINDOW, ENDS_OF_16, LONGEST, RUN, WORDS, SINGLE = 8, 3, 240, 160, 50, 48
#: Bytes without white space before a place between two characters where a chunk may end.
SOLID = 64

#: The type of the removed spans.
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

#: The gear table: 256 fixed pseudo-random numbers from a seeded generator.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
BLANK = b" \t\n\v\f\r"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes; the last is the length.

    The sum of the shifted gear values over the window is built by doubling; its highest bits, which depend on every byte, decide. All that decides
    lies within the last SOLID bytes, so equal passages are cut alike behind their first bytes.
    """
    if not len(data):
        return np.empty(0, dtype=np.int64)
    h, span = GEAR[data], 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span] if span < len(h) else 0
        h = h + (older << np.uint16(span))
        span *= 2
    blank = SPACE[data]
    ends = np.flatnonzero(blank & (((h >> np.uint16(7)) & np.uint16(15)) < ENDS_OF_16)) + 1
    if len(data) > SOLID:
        seen = np.concatenate(([0], np.cumsum(blank, dtype=np.int64)))
        solid = seen[SOLID:-1] == seen[: -1 - SOLID]  # no white space in the SOLID bytes before each place from SOLID on, but for the end
        if solid.any():
            places = np.flatnonzero(solid) + SOLID
            starts_here = ((data[places] & 0xC0) != 0x80) & (h[places - 1] >> np.uint16(12) == 0) & (h[places - 1] != h[places - 2])
            ends = np.union1d(ends, places[starts_here])
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate(([0], ends[:-1]))
    far = np.flatnonzero(ends - starts > LONGEST)
    if len(far):
        more = np.concatenate([np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in far])
        while (inside := (data[more] & 0xC0) == 0x80).any():  # to the next start of a character
            more = np.where(inside, more - 1, more)
        ends = np.union1d(ends, more)
    return ends


def chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc, digest and place (256 x number + bytes) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            digests, counts, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                ends = chunk_ends(np.frombuffer(raw, dtype=np.uint8))
                cuts = [0, *ends.tolist()]
                digests += [digest_of(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                counts.append(len(ends))
                sizes.append(np.diff(ends, prepend=0))
            counts = np.array(counts, dtype=np.int64)
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            place = number * 256 + np.concatenate(sizes or [np.empty(0, np.int64)]).astype(np.int64)
            doc = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(np.repeat(doc, counts), pa.int64()), "digest": pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), "place": pa.array(place)})

    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, "doc long, digest long, place long")


def runs(chunks: list[dict]) -> list[tuple]:
    """Runs of repeated chunks, from their (place, digest, least): first and last number, size, and for the start and the end of each run the
    chunk of the chosen lesser document that is nearest to it: (document, digest, bytes between)."""
    rows = sorted({(c["place"], c["digest"], c["least"]) for c in chunks})
    found, at = [], 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][0] // 256 == rows[end - 1][0] // 256 + 1:
            end += 1
        run = rows[at:end]
        sizes = [place % 256 for place, _, _ in run]
        size = sum(sizes)
        if len(run) > 1 or size >= SINGLE:
            shares: dict[int, int] = {}
            for n, (_, _, least) in zip(sizes, run):
                shares[least] = shares.get(least, 0) + n
            source = min(shares, key=lambda d: (-shares[d], d))
            own = [i for i, r in enumerate(run) if r[2] == source]
            found.append((run[0][0] // 256, run[-1][0] // 256, size, (source, run[own[0]][1], sum(sizes[: own[0]])), (source, run[own[-1]][1], sum(sizes[own[-1] + 1 :]))))
        at = end
    return found


def ends_of_runs(again: DataFrame) -> DataFrame:
    """Two rows for each run: first, last, size, side (0 start, 1 end), and source, digest and bytes between of the chunk that anchors this side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for first, last, size, *sides in runs(chunks):
                    out += [(doc, first, last, size, side, *anchor) for side, anchor in enumerate(sides)]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "first", "last", "size", "side", "source", "digest", "between"])

    return again.mapInArrow(run, "doc long, first long, last long, size long, side long, source long, digest long, between long")


def around(docs: DataFrame, ends: DataFrame, text: str, key: str) -> DataFrame:
    """source, digest, side and near: what stands before (side 0) or behind the chunks with that digest in the source, as far as any run needs it."""
    asked = ends.groupBy("source", "digest", "side").agg((F.max("between") + LONGEST + WINDOW).alias("need"))
    asked = asked.groupBy("source").agg(F.collect_list(F.struct("digest", "side", "need")).alias("asked"))
    rows = asked.join(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), F.col("source") == F.col("k")).select("source", "asked", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: dict[tuple[int, int, int], set[bytes]] = {}
            for source, asked, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                wanted: dict[int, list[tuple[int, int]]] = {}
                for a in asked:
                    wanted.setdefault(a["digest"], []).append((a["side"], a["need"]))
                raw = (t or "").encode("utf-8", "surrogatepass")
                cuts = [0, *chunk_ends(np.frombuffer(raw, dtype=np.uint8)).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    digest = digest_of(raw[a:b])
                    digest -= (digest >> 63) << 64
                    for side, need in wanted.get(digest, ()):
                        out.setdefault((source, digest, side), set()).add(raw[b : b + need] if side else raw[max(0, a - need) : a])
            sources, digests, sides = list(zip(*out)) or ((), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(sources, pa.int64()), pa.array(digests, pa.int64()), pa.array(sides, pa.int64()), pa.array([sorted(v) for v in out.values()], pa.list_(pa.binary())),
            ], names=["source", "digest", "side", "near"])

    return rows.mapInArrow(run, "source long, digest long, side long, near array<binary>")


def between_words(raw: bytes, at: int) -> bool:
    return at == 0 or at == len(raw) or raw[at - 1] in BLANK or raw[at] in BLANK


def solid(raw: bytes, at: int) -> bool:
    """No white space about here: words have no say."""
    return not any(b in BLANK for b in raw[max(0, at - SOLID) : at]) or not any(b in BLANK for b in raw[at : at + SOLID])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a[:low] is equal, a[:n] is not
        middle = (low + n) // 2
        low, n = (middle, n) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def begin_of(raw: bytes, start: int, between: int, near: list[bytes]) -> int:
    """Where the passage begins whose run begins at start: the first beginning of a word from which on raw equals one of near up to the anchor."""
    best, anchor = start, start + between
    for other in near:
        mine = raw[max(0, anchor - len(other)) : anchor]
        n = common_prefix(mine[::-1], other[::-1])
        at, there = anchor - n, len(other) - n
        if not ((at == 0 or raw[at - 1] in BLANK) and (there == 0 or other[there - 1] in BLANK)):
            word = next((i + 1 for i in range(at, start) if raw[i] in BLANK), start)
            while at < word and raw[at] & 0xC0 == 0x80:
                at += 1
            at = at if word - at > SOLID or word == start and not between_words(raw, start) and solid(raw, at) else word
        best = min(best, at)
    return best


def end_of(raw: bytes, end: int, between: int, near: list[bytes]) -> int:
    """Where the passage ends whose run ends at end."""
    best, anchor = end, end - between
    for other in near:
        n = common_prefix(raw[anchor : anchor + len(other)], other)
        at = anchor + n
        if not ((at == len(raw) or raw[at] in BLANK) and (n == len(other) or other[n] in BLANK)):
            word = next((i for i in range(at, end, -1) if raw[i - 1] in BLANK), end)
            while word < at < len(raw) and raw[at] & 0xC0 == 0x80:
                at -= 1
            at = at if at - word > SOLID or word == end and not between_words(raw, end) and solid(raw, at) else word
        best = max(best, at)
    return best


def cut(text: str, found: list[dict] | None) -> tuple[str, list[tuple[int, int]]]:
    """The text without its repeated passages, and their spans in code points. found: the ends of runs with what is near their anchors."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [0, *chunk_ends(np.frombuffer(raw, dtype=np.uint8)).tolist()]
    passages: dict[tuple[int, int, int], list[int]] = {}
    for f in found or ():
        # rows that repeat a document's id may have another text, in which the run is not
        if f["last"] + 1 >= len(ends):
            continue
        passage = passages.setdefault((f["first"], f["last"], f["size"]), [ends[f["first"]], ends[f["last"] + 1]])
        if f["side"]:
            passage[1] = max(passage[1], end_of(raw, ends[f["last"] + 1], f["between"], f["near"] or []))
        else:
            passage[0] = min(passage[0], begin_of(raw, ends[f["first"]], f["between"], f["near"] or []))
    kept, spans, at, chars = [], [], 0, 0
    for (_, _, size), (start, end) in sorted(passages.items()):
        if size < RUN and len(raw[start:end].split()) < WORDS:
            continue
        start = max(start, at)
        if end <= start:
            continue
        before, inside = (raw[a:b].decode("utf-8", "surrogatepass") for a, b in ((at, start), (start, end)))
        kept.append(before)
        chars += len(before)
        if spans and not before:
            spans[-1] = (spans[-1][0], chars + len(inside))
        else:
            spans.append((chars, chars + len(inside)))
        chars += len(inside)
        at = end
    kept.append(raw[at:].decode("utf-8", "surrogatepass"))
    return "".join(kept), spans


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", spans: str = "removed_spans") -> DataFrame:
    """docs with the text cut, and the spans removed from it (array of start and end in code points of the old text)."""
    found = chunks(docs, text, key)
    # written first, so that the join reads both sides from exchanges and Spark can split the occurrences of one frequent chunk
    shared = stored(found.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("digest", "least"), "shared")
    again = found.join(shared, "digest").where("doc > least").groupBy("doc").agg(F.collect_list(F.struct("place", "digest", "least")).alias("chunks"))
    ends = stored(ends_of_runs(again), "runs")
    released(shared)
    near = ends.join(around(docs, ends, text, key), ["source", "digest", "side"], "left")
    again = near.groupBy("doc").agg(F.collect_list(F.struct("first", "last", "size", "side", "between", "near")).alias("places"))
    doc, places = scratch_name(docs, "doc"), scratch_name(docs, "places")
    joined = docs.join(again.select(F.col("doc").alias(doc), F.col("places").alias(places)), F.col(key) == F.col(doc), "left").drop(doc)
    out = [c for c in docs.columns if c != spans]
    schema = docs.select(out).schema.add(spans, SPANS)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, p in zip(batch.column(text).to_pylist(), batch.column(places).to_pylist()):
                now, gone = cut(t, p) if t and p else (t, [])
                texts.append(now)
                removed.append([{"start": a, "end": b} for a, b in gone])
            columns = [pa.array(texts, batch.schema.field(text).type) if c == text else batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind)], names=[*out, spans])

    return joined.mapInArrow(run, schema)


def op7_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that stays, its length, how many code points went, and the spans that went as start-end pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return deduplicate(docs).select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), gone.alias("n_removed"), listed.alias("spans"))


QUERIES = {"op7_gear_chunk_dedup": op7_gear_chunk_dedup}

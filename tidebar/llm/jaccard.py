"""Exact Jaccard self-join on word shingles: a size-aware heavy-light join, and its connected components.

1. Equal shingle sets are one class; only its smallest doc_id goes on, so copies cost nothing more, however many there are.
2. Shingles get a global order: by hash, but with the frequent ones last. Two sets that link overlap so much that their prefixes in this order
   share several shingles: with overlap >= o, the first |x| - o + k shingles of x and those of y have at least k in common.
3. Small sets enumerate all subsets of two shingles of their prefix (k = 2), large ones scan inverted lists of their prefix (k = 3). The boundary
   follows from the cost: a set enumerates while it has no more subsets than the inverted lists are expected to make it read.
4. Groups are made so that no long inverted list emits pairs: sets that share enough with the least member of their lists are one group, and a
   list of more than PAIRED rows lies in one group as a whole. A group is compared in blocks of bounded size by bitsets. Short lists pair the sets of
   different groups, so a row of a list meets fewer than PAIRED others; pairs that share enough are compared.
5. A verified unit returns one row for each linked set: its least linked member and its number of links. Components follow by star contraction.

Nothing is approximate: hashes of 64 bits name shingles, sets are compared whole, and the heavy table only orders shingles. Prefixes hold the upper
halves of the hashes; a half that stands twice in a set stands there as two keys, so no shared shingle is lost.

Edge cases: null and empty texts, and such of white space alone, have no shingles and link with nothing; rows that repeat a doc_id count as copies
where their texts are equal; rows without a doc_id keep their rows, in a component without number; an empty table gives an empty result; columns
other than the key are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import most_frequent, released, stored, table, words_of
from .graph import components

#: Lists longer than this make a shingle heavy; so many heavy shingles are kept at most (4 bytes each in the broadcast), the heaviest ones.
HEAVY, MOST_HEAVY = 12, 1_000_000
#: Shingles that prefixes must share: subsets of two, or three by scanning lists.
SUBSET, SCAN = 2, 3
#: Rows of the longest inverted list whose sets are paired; the sets of a longer one are put into one group.
PAIRED = 48
#: Bits of a key that say that it is a subset's, and that it has heavy shingles only; other lists are short.
SUBSETS, HOT = 1 << 62, 1 << 61
#: Shingles in a block of a group at most (of its sets' sum), which bounds the memory of a verification.
BLOCK_SHINGLES = 400_000
#: Documents that may be selected by a broadcast of their ids; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Documents with the same set from which their class is broadcast to them, so that they need not meet in one task.
HOT_COPIES = 1000

#: Odd multipliers that mix hashes.
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_word_hash: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_word_hash) > 400_000:
        _word_hash.clear()
    known, digest = _word_hash, xxhash.xxh3_64_intdigest
    for w in set(words):
        if w not in known:
            known[w] = digest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, size: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where it is shorter; none without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    n = min(size, len(words))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = _mixed(x * MIX + h[i : len(h) - n + 1 + i])
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def prefix_length(n: int, k: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + k)


def ordered_keys(hashes: np.ndarray, heavy: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The first `most` keys of a set in the global order: light before heavy, then by key; a key is the upper half of a hash. And how many are light."""
    keys = (hashes >> np.uint64(32)).astype(np.uint32)
    light = len(keys)
    if len(heavy) and len(keys):
        is_heavy = heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys
        light = len(keys) - int(is_heavy.sum())
        keys = np.concatenate((keys[~is_heavy][:most], keys[is_heavy][:most]))
    return keys[:most], min(light, most)


def instances(keys: np.ndarray) -> np.ndarray:
    """Keys as 64-bit numbers; one that stands again in a set is numbered, so that all are distinct. Equal keys are neighbours."""
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    out, starts = keys.astype(np.int64), np.flatnonzero(first)
    if len(starts) < len(keys):
        out += (np.arange(len(keys)) - starts[np.cumsum(first) - 1]) << 32
    return out


def heavy_keys(docs: DataFrame, text: str, size: int, percent: int) -> tuple[np.ndarray, float]:
    """The most frequent keys, sorted, and how many sets a light key's list is expected to hold, over all documents.

    Counted are the keys that prefixes by hash alone would hold, twice over and 48 more, so that a passage that many share is seen as a whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, found = set(), [np.empty(0, dtype=np.uint32)]
            for t in batch.column(0).to_pylist():
                if t and (mark := xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))) not in seen:
                    seen.add(mark)
                    hashes = shingle_set(t, size)
                    found.append(ordered_keys(hashes, np.empty(0, np.uint32), 2 * prefix_length(len(hashes), 0, percent) + 48)[0])
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int32)), "n": pa.array(n.astype(np.int32))})

    counts = stored(docs.select(text).mapInArrow(count, "key int, n int").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "keys")
    light = counts.where(F.col("n") <= HEAVY).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    top = most_frequent(counts.where(F.col("n") > HEAVY), MOST_HEAVY)
    heavy = np.concatenate([np.empty(0, np.int32), *(np.asarray(b, dtype=np.int32) for b in top.select("key").toArrow().column(0).chunks)])
    released(counts)
    return np.sort(heavy.view(np.uint32)), (light[0] or 0) / max(1, light[1] or 0)


def boundary(list_length: float, percent: int) -> int:
    """The largest size of a small set: while its two-subsets are no more than the rows that scanning the lists of its prefix would read."""
    n = 7
    while (m := prefix_length(n + 1, SUBSET, percent)) * (m - 1) / 2 <= prefix_length(n + 1, SCAN, percent) * max(2.0, list_length):
        n += 1
    return n


def signatures(docs: DataFrame, heavy: np.ndarray, small: int, text: str, key: str, size: int, percent: int) -> DataFrame:
    """key, digest and n_shingles of the whole set, and the keys under which it can meet others."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, digest binary, n_shingles long, keys array<bigint>"
    lists_from = -(-percent * (small + 1) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in batches:
            digest, count, keys, ends = [], [], [np.empty(0, np.int64)], [0]
            for t in batch.column(1).to_pylist():
                hashes = shingle_set(t, size)
                n = len(hashes)
                digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                count.append(n)
                first, light = ordered_keys(hashes, heavy, prefix_length(n, SCAN, percent))
                own, out = instances(first), []
                own[light:] |= HOT
                if n >= lists_from:
                    out.append(own)
                if n <= small:
                    first = np.sort(own[: prefix_length(n, SUBSET, percent)])
                    i, j = np.triu_indices(len(first), 1)
                    pairs = _mixed(_mixed(first[i].astype(np.uint64)) + first[j].astype(np.uint64))
                    out.append(np.unique((pairs >> np.uint64(3)).astype(np.int64) | (first[i] & first[j] & HOT) | SUBSETS))
                keys += out
                ends.append(ends[-1] + sum(map(len, out)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(count, pa.int64()), lists], names=[key, "digest", "n_shingles", "keys"])

    return docs.select(key, text).mapInArrow(run, schema)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compared(reps: np.ndarray, weights: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list, list, list]:
    """All links of a unit: between sides 0 and 1, or within side 2. For each linked set: itself, its least linked member here, its links.

    A shingle that only one set of the unit has can't be in an intersection, so bitsets cover the others alone.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    keep = common[where]
    bits = np.zeros((n, int(common.sum()) // 64 + 1), dtype=np.uint64)
    at = number[where[keep]]
    np.bitwise_or.at(bits, (owner[keep], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    parent, links = list(range(n)), np.zeros(n, dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    ordered_sizes = sizes[order]
    for place, x in enumerate(order):
        # only later ones in order of size, up to the largest that can link
        end = np.searchsorted(ordered_sizes, 100 * sizes[x] / percent, side="right")
        others = order[place + 1 : end]
        others = others[(sides[others] + sides[x] == 1) | (sides[x] == 2)]
        if not len(others):
            continue
        shared = np.bitwise_count(bits[others] & bits[x]).sum(axis=1, dtype=np.int64)
        for y in others[100 * shared >= percent * (sizes[others] + sizes[x] - shared)]:
            links[x] += weights[y]
            links[y] += weights[x]
            a, b = _find(parent, int(x)), _find(parent, int(y))
            if a != b:
                low, high = (a, b) if reps[a] < reps[b] else (b, a)
                parent[high] = low
    linked = np.flatnonzero(links)
    return reps[linked].tolist(), [int(reps[_find(parent, int(i))]) for i in linked], links[linked].tolist()


def linked_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked, classes, links). marked: key, digest and n_shingles of each document. classes: digest, rep, copies (the documents with that set) and n.
    links: rep, other, n_links: one row for each verified unit in which the class has links, with the least class that it reaches there and the
    linked documents.

    Sets without shingles have no class and no links. Null texts count as empty. key is an integer; null keys keep their rows and represent no class.
    """
    found, list_length = heavy_keys(docs, text, size, percent)
    marked = stored(signatures(docs, found, boundary(list_length, percent), text, key, size, percent), "signatures")
    by_digest = marked.where("n_shingles > 0").groupBy("digest")
    classes = stored(by_digest.agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").cast("int").alias("n")), "classes")
    postings = by_digest.agg(F.min(key).alias("rep"), F.first("keys").alias("keys")).where("rep IS NOT NULL").select("rep", F.explode("keys").alias("key"))
    lists = stored(inverted(postings), "lists")
    slim = stored(marked.select(key, "digest", "n_shingles"), "marked")
    released(marked)
    group = grouped(lists)
    across = paired(lists, group, classes.select("rep", "n"), percent)
    released(lists)
    # two columns for a group, so that units within one and units of two have the same shape
    inside = group.join(group.groupBy("label").count().where("count > 1"), "label").select(F.col("label").alias("la"), F.col("label").alias("lb"), "rep", F.lit(2).alias("side"))
    left = across.select("la", "lb", F.col("a").alias("rep"), F.lit(0).alias("side"))
    right = across.select("la", "lb", F.col("b").alias("rep"), F.lit(1).alias("side"))
    members = stored(inside.union(left.union(right).distinct()).join(classes.select("rep", "copies", "n"), "rep"), "members")
    released(group, across)
    links = verified(docs, in_blocks(members), text, key, size, percent)
    released(members)
    return slim, classes, links


def inverted(postings: DataFrame) -> DataFrame:
    """The rows (rep, key, hub, long) of lists of two rows or more; hub is the list's least member, long its length.

    A list that holds a light shingle is short, and a window takes it in one shuffle; of the others, hub and length are aggregated in the tasks first.
    """
    hot = F.col("key").bitwiseAND(F.lit(HOT)) != 0
    by_key = Window.partitionBy("key")
    light = postings.where(~hot).withColumns({"hub": F.min("rep").over(by_key), "long": F.count("*").over(by_key)}).where("long > 1")
    heavy = postings.where(hot)
    heads = heavy.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("long")).where("long > 1")
    return light.select("rep", "key", "hub", "long").union(heavy.join(heads, "key").select("rep", "key", "hub", "long"))


def weight() -> Column:
    """What a shared key tells: a subset as much as all that must be shared."""
    return F.when(F.col("key") < F.lit(SUBSETS), 1).otherwise(SCAN)


def grouped(lists: DataFrame) -> DataFrame:
    """(rep, label) of the sets that can link with any: their group, named by its least member. Of a list of more than PAIRED rows, all are in one group."""
    votes = stored(lists.groupBy("rep", "hub").agg(F.sum(weight()).alias("votes")), "votes")
    able = votes.groupBy("rep").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= SCAN).select("rep")
    named = components(votes.where((F.col("votes") >= SCAN) & (F.col("hub") < F.col("rep"))).select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    group = able.join(named, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("label"))
    of_lists = lists.where(F.col("long") > PAIRED).select("key", "rep").join(group, "rep").groupBy("key", "label").agg(F.lit(1).alias("one"))
    least = of_lists.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    apart = stored(of_lists.join(least, "key").where("low < label").select(F.col("label").alias("a"), F.col("low").alias("b")).distinct(), "apart")
    wider = components(apart).withColumnsRenamed({"node": "label", "component": "wide"})
    out = stored(group.join(wider, "label", "left").select("rep", F.coalesce("wide", "label").alias("label")), "groups")
    released(votes, apart)
    return out


def paired(lists: DataFrame, group: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, la, lb) of sets of different groups that share enough. Lists in one group make none, and longer ones than PAIRED always are."""
    placed = lists.where(F.col("long") <= PAIRED).select("key", "rep").join(group, "rep")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    placed = stored(placed.join(mixed, "key").join(sizes, "rep"), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    near = (F.col("x.n") * percent <= F.col("y.n") * 100) & (F.col("y.n") * percent <= F.col("x.n") * 100)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & near)
    shared = pairs.select(F.col("x.key").alias("key"), F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
    out = stored(shared.groupBy("a", "b", "la", "lb").agg(F.sum(weight()).alias("s")).where(F.col("s") >= SCAN).drop("s"), "across")
    released(placed)
    return out


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (la, lb, side, rep, copies, n) dealt to units of bounded size: la, lb, i, j, and the side in it.

    Each side is cut into blocks by its shingles. Blocks of two sides meet each once; those of one group (side 2) meet each other once, and themselves.
    """
    cut = members.groupBy("la", "lb", "side").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    sided = cut.groupBy("la", "lb").agg(F.max(F.when(F.col("side") == 0, F.col("blocks"))).alias("n0"), F.max(F.when(F.col("side") == 1, F.col("blocks"))).alias("n1"), F.max(F.when(F.col("side") == 2, F.col("blocks"))).alias("n2"))
    at = members.join(sided, ["la", "lb"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("n0")).when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n2"))).cast("int"))
    partner = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("n1") - 1)).when(F.col("side") == 1, F.sequence(F.lit(0), F.col("n0") - 1)).otherwise(F.sequence(F.lit(0), F.col("n2") - 1))
    spread = at.withColumn("other", F.explode(partner))
    i = F.when(F.col("side") == 0, F.col("b")).when(F.col("side") == 1, F.col("other")).otherwise(F.least("b", "other"))
    j = F.when(F.col("side") == 0, F.col("other")).when(F.col("side") == 1, F.col("b")).otherwise(F.greatest("b", "other"))
    side = F.when(F.col("side") < 2, F.col("side")).when(F.col("b") == F.col("other"), 2).when(F.col("b") < F.col("other"), 0).otherwise(1)
    return spread.select("la", "lb", i.alias("i"), j.alias("j"), side.alias("side"), "rep", "copies")


def verified(docs: DataFrame, units: DataFrame, text: str, key: str, size: int, percent: int) -> DataFrame:
    """rep, other and n_links of every linked class of every unit, from the whole texts."""
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).where("rep IS NOT NULL")
    ids = units.select("rep").distinct()
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "rep", "left_semi")
    full = units.join(texts, "rep").select("la", "lb", "i", "j", "side", "rep", "copies", "text")

    def compare(rows: pa.Table) -> pa.Table:
        _, first = np.unique(rows.column("rep").to_numpy(), return_index=True)  # repeated rows of a document
        rows = rows.take(pa.array(first))
        sets = [shingle_set(t, size) for t in rows.column("text").to_pylist()]
        out = _compared(rows.column("rep").to_numpy(), rows.column("copies").to_numpy(), rows.column("side").to_numpy(), sets, percent)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("rep", "other", "n_links"), out)})

    return stored(full.groupBy("la", "lb", "i", "j").applyInArrow(compare, "rep long, other long, n_links long"), "links")


def with_components(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach) and n_links (documents that this one links with, copies included)."""
    marked, classes, links = linked_classes(docs, text, key, size, percent)
    found = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    reached = links.groupBy("rep").agg(F.sum("n_links").alias("own_links")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    told = classes.join(reached, "rep", "left").select(
        "digest", "copies", F.coalesce("component", "rep").alias("component_id"),
        F.when(F.col("rep").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("own_links", F.lit(0))).cast("long").alias("n_links"))
    told = stored(told, "told")
    released(links)
    return of_class(marked, told, key)


def of_class(marked: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """Each document with what its class (by digest) is told; those without shingles have no class. Both are read twice and should be stored.

    Classes of many copies go to the documents by broadcast, if there are few enough of them, so no task gets all the copies of a text.
    """
    keyed, none = marked.where("n_shingles > 0"), marked.where("n_shingles = 0")
    hot = told.where(F.col("copies") > HOT_COPIES)
    parts = []
    if 0 < hot.count() <= BROADCAST_IDS:
        parts.append(keyed.join(F.broadcast(hot), "digest"))
        keyed, told = keyed.join(F.broadcast(hot.select("digest")), "digest", "left_anti"), told.where(F.col("copies") <= HOT_COPIES)
    parts.append(keyed.join(told, "digest"))
    out = none.select(key, "n_shingles", F.col(key).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    for part in parts:
        out = out.unionAll(part.select(key, "n_shingles", F.coalesce(F.col("component_id"), F.col(key)).alias("component_id"), "n_links"))
    return out


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose key is the least of their component: one document of each group, with docs' columns.

    Rows that repeat a key with the same text count once; rows without a key, or without words, stay.
    """
    found = stored(with_components(docs, text, key, size, percent).where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("rows")), "kept")
    again = found.where(F.col("rows") > 1).select(key)
    # one plan at every size: few ids are not broadcast, nor are texts sorted
    kept = docs.join(found.where(F.col("rows") == 1).select(key).hint("shuffle_hash"), key, "left_semi").select(docs.columns)
    if again.take(1):
        kept = kept.union(docs.join(again, key, "left_semi").dropDuplicates([key, text]).select(docs.columns))
    return kept.union(docs.where(F.col(key).isNull()))


def op10_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op10: 4-word shingles, 85 percent."""
    return with_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_size_aware_jaccard": op10_size_aware_jaccard}

ORACLE_SQL = {
    "op10_size_aware_jaccard": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT r, s FROM (
    SELECT r, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM d WHERE len(w) >= 4
    UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM sets a JOIN sets b USING (s) WHERE a.r <> b.r GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT a AS r, b AS other FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT reach.r, min(doc_id) AS least FROM reach JOIN d ON d.r = reach.other GROUP BY 1),
linked AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least.least, doc_id)) AS component_id, coalesce(linked.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN sizes USING (r) LEFT JOIN least USING (r) LEFT JOIN linked USING (r)""",
}

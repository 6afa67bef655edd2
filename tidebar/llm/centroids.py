"""Centroid clustering of integer vectors, exact at any magnitude.

Each round is one pass over the vectors. A task works on blocks: squared distances come from one matrix product, |x|^2 - 2 x.c + |c|^2, in float64.
All its terms are integers, so the result is exact as long as they stay below 2^53, which the largest components of the block and of the centroids show
beforehand; a block that may exceed it is computed in 64-bit integers, and in Python's where these may overflow too. A task keeps sums and counts by cluster,
Python integers, and treeAggregate combines those of all tasks, so the driver gets one small table a round whatever the number of tasks. Only the
centroids travel to the tasks: their number is a parameter, not a function of the data.

Edge cases: vectors of another length, null, or with a null or non-finite component (or one that 256 times overflows a double) are left out; rows
that repeat a vec_id are vectors of their own; a null vec_id hashes as an empty one; fewer vectors than clusters give as many clusters as there are
vectors; an empty table gives an empty result; a distance or an inertia beyond a long is null; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

BLOCK_ROWS = 4096
EXACT = 1 << 53
LONG = 1 << 63


def whole(block: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of each component: int64, or Python integers where one doesn't fit."""
    scaled = np.floor(block.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < LONG / 2:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], dtype=object)


def largest(rows: np.ndarray) -> int:
    return max(abs(int(rows.min())), abs(int(rows.max()))) if rows.size else 0


def squared_distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centers, in the cheapest type that is exact."""
    a, b = largest(rows), largest(centers)
    bound = rows.shape[1] * (a + b) ** 2  # |x|^2 + 2|x.c| + |c|^2 at most, and each partial sum
    if bound < EXACT:
        x, c = rows.astype(np.float64), centers.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    kind = np.int64 if bound < LONG else object
    x, c = rows.astype(kind), centers.astype(kind)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster, the smaller number among ties, and its distance."""
    distances = squared_distances(rows, centers)
    cluster = np.argmin(distances, axis=1) if distances.dtype != object else np.array([min(range(len(d)), key=d.__getitem__) for d in distances], np.int64)
    return cluster, distances[np.arange(len(rows)), cluster]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of some rows with their integer vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size))


class Sums:
    """Of each cluster: componentwise sums, rows and distances, as Python integers."""

    def __init__(self, k: int, size: int):
        self.sums, self.counts, self.inertia = np.full((k, size), 0, dtype=object), [0] * k, [0] * k

    def add(self, rows: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
        small = rows.dtype != object and largest(rows) * len(rows) < LONG
        for i in np.unique(cluster):
            own = cluster == i
            total = rows[own].sum(0) if small else rows[own].astype(object).sum(0)
            self.sums[i] += total.astype(object)
            self.counts[i] += int(own.sum())
            self.inertia[i] += sum(map(int, distance[own]))

    def merged(self, other: Sums) -> Sums:
        self.sums = self.sums + other.sums
        self.counts = [a + b for a, b in zip(self.counts, other.counts)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia)]
        return self


def totals(vectors: DataFrame, centers: np.ndarray) -> Sums:
    """The Sums of all vectors (key, embedding) at these centers: partial ones of each task, combined by a tree."""
    k, size = centers.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sums(k, size)
        for _, rows in blocks(batches, size):
            own.add(rows, *nearest(rows, shared.value))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(own)], pa.binary())})

    parts = vectors.mapInArrow(run, "sums binary").rdd
    found = parts.treeAggregate(None, lambda so_far, row: _both(so_far, pickle.loads(bytes(row[0]))), _both)
    shared.unpersist()
    return found or Sums(k, size)


def _both(a: Sums | None, b: Sums | None) -> Sums | None:
    return a.merged(b) if a and b else a or b


def moved(centers: np.ndarray, found: Sums) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    return _tight([[int(s) // n for s in found.sums[i]] if (n := found.counts[i]) else [int(c) for c in centers[i]] for i in range(len(centers))])


def _tight(rows: list[list[int]]) -> np.ndarray:
    fits = all(abs(v) < LONG // 2 for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if fits else object)


def kept_vectors(df: DataFrame, size: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """key and vector of the rows whose vectors have `size` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    return df.select(key, vector).where((F.size(vector) == size) & finite)


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of their keys, as integers."""
    key, vector = vectors.columns
    order = F.sha2(F.concat(F.lit(f"{seed}:"), id_text(key)), 256)
    first = vectors.orderBy(order, key, vector).limit(k).collect()  # k rows
    return _tight([[int(v) for v in row] for row in whole(np.array([r[1] for r in first], np.float64))])


def cluster(df: DataFrame, *, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector kept, after `rounds` rounds."""
    vectors = kept_vectors(df, size, key, vector)
    schema = vectors.select(key).schema.add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string")
    centers = seeds(vectors, k, seed)
    if not len(centers):
        return df.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centers = moved(centers, totals(vectors, centers))
    inertia = totals(vectors, centers).inertia
    own, everything = [_long(v) for v in inertia], _long(sum(inertia))
    digests = [hashlib.sha256(",".join(map(str, map(int, row))).encode()).hexdigest() for row in centers]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in blocks(batches, size):
            found, distance = nearest(rows, centers)
            columns = [pa.array(found, pa.int32()), pa.array([_long(int(d)) for d in distance], pa.int64()), pa.array([own[i] for i in found], pa.int64()), pa.array([everything] * len(found), pa.int64()), pa.array([digests[i] for i in found], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return vectors.mapInArrow(assign, schema)


def _long(value: int) -> int | None:
    return value if value < LONG else None


def op13_gemm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op13: 40 centroids, 5 rounds, 64 components."""
    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_gemm_centroids": op13_gemm_centroids}


def _sql(k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS cluster, x AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, vec_id, x FROM v ORDER BY h, vec_id LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, x, cluster, distance FROM (SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v, c{i}) "
            "QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT cluster, list(m ORDER BY j) AS c FROM (SELECT cluster, j, floor(sum(y)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT cluster, unnest(x) AS y, unnest(range({size})) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE_SQL = {"op13_gemm_centroids": _sql()}

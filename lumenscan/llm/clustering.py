"""Centroid clustering of integer vectors with block-norm screening.

A vector is kept as its integer components and the norms of its BLOCKS segments, both computed once. By the Cauchy-Schwarz inequality a
segment of a vector and one of a centroid are at least the difference of their norms apart, so the squares of these differences, summed,
bound the distance of the two from below. A batch of vectors is first compared by these compressed forms only; the centroid of least bound
gets an exact distance, and of the others only those whose bound does not exceed it. Distances are exact integers, so the screening
(with room for rounding) never changes a result, ties included.

Each round assigns all vectors where they are; tasks send the sums of their clusters, one row a cluster, and Spark adds them up. The
centroids, a fixed number of rows, are all that the driver ever sees.

Defined results: vectors with a null or non-finite component, of another length, or null, are left out, and so are those with a component
beyond LARGEST, whose distances would not fit a long; with fewer vectors than clusters each vector starts one; equal vectors are vectors
each; vec_ids may repeat or be null (as an empty text in the hash that chooses the first centroids, whose ties go by components); an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import lists
from .common import lean, staged, table

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
BLOCKS = 8
#: So that SIZE squared differences of two components fit a long.
LARGEST = 1 << 27


def norms(vectors: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """The norms of each vector's segments."""
    return np.sqrt((vectors.astype(np.float64) ** 2).reshape(len(vectors), blocks, -1).sum(2))


def assigned(vectors: np.ndarray, compressed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the smaller number of two, with its exact squared distance; and how many distances were
    computed."""
    own = norms(centroids, compressed.shape[1])
    bounds = np.stack([((compressed - c) ** 2).sum(1) for c in own], 1)
    bounds = bounds * (1 - 1e-9) - 1e-6  # never above the true bound, whatever the rounding
    rows = np.arange(len(vectors))
    exact = lambda some, which: ((vectors[some] - centroids[which]) ** 2).sum(1)
    best = bounds.argmin(1)
    distance, first, computed = exact(rows, best), best.copy(), len(rows)
    for k in range(len(centroids)):
        some = np.flatnonzero((bounds[:, k] <= distance) & (first != k))
        found = exact(some, k)
        computed += len(some)
        better = (found < distance[some]) | ((found == distance[some]) & (k < best[some]))
        best[some[better]], distance[some[better]] = k, found[better]
    return best, distance, computed


def quantised(rows: DataFrame, size: int = SIZE, scale: int = SCALE, blocks: int = BLOCKS, vector: str = "embedding") -> DataFrame:
    """vec_id, components (floor(scale * x)) and segment norms of every vector that is kept."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * scale))
    whole = F.forall(F.col(vector).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == size)).filter(F.coalesce(whole, F.lit(False)))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("components"))

    def compress(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = norms(_matrix(batch.column(1), size), blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(list(found), pa.float64())], ["vec_id", "components", "norms"])

    return kept.mapInArrow(lean(compress), "vec_id long, components array<int>, norms array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The components of the vectors of smallest hash, as many as there are clusters."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("hash"), "components").orderBy("hash", "components").limit(clusters).collect()
    return np.array([r["components"] for r in rows], np.int64)


def round_of(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floors of their vectors' means; empty ones stay."""
    k, size = centroids.shape

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in source:
            x = _matrix(batch.column(0), size).astype(np.int64)
            to = assigned(x, _matrix(batch.column(1), len(batch.column(1)[0])), centroids)[0] if len(x) else np.empty(0, np.int64)
            count += np.bincount(to, minlength=k)
            for c in np.unique(to).tolist():
                total[c] += x[to == c].sum(0)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), *(pa.array(total[some, i], pa.int64()) for i in range(size))], ["cluster", "n", *(f"s{i}" for i in range(size))])

    names = ["n", *(f"s{i}" for i in range(size))]
    found = vectors.select("components", "norms").mapInArrow(lean(sums), "cluster int, " + ", ".join(f"{c} long" for c in names))
    out = centroids.copy()
    for r in found.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["cluster"]] = [r[c] // r["n"] for c in names[1:]]
    return out


def clustered(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def assign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                x = _matrix(batch.column(1), centroids.shape[1]).astype(np.int64)
                to, distance, _ = assigned(x, _matrix(batch.column(2), len(batch.column(2)[0])), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(lean(assign), "vec_id long, cluster int, distance long")


def fitted(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after so many rounds over a table of quantised vectors."""
    out = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(out) else 0):
        out = round_of(vectors, out)
    return out


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of embeddings; see the module's defined results."""
    vectors = staged(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    centroids = fitted(vectors)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = staged(clustered(vectors, centroids), "clusters")
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    each = [(k, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist()) if k in sums]
    totals = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a cluster
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

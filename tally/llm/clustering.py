"""Centroid clustering by Lloyd's rounds over dimension shards.

Vectors lie in chunks, each cut into blocks of columns. In a round, a task
measures a block's vectors against the centroids' slice of the same columns;
the partial distances of a chunk's blocks are added by key and each vector
takes its nearest centroid; then every shard sums its own columns by cluster
and so moves its own slice. Components are whole numbers and all sums exact,
so the result does not depend on how rows are dealt or tasks repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialise

#: Vectors of a chunk at most.
CHUNK = 4096
#: A component is floor(SCALE * x).
SCALE = 256
#: The block number of the rows that hold a chunk's ids.
IDS = -1
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53


def largest(dims: int) -> int:
    """The largest component for which any squared distance fits a long."""
    return isqrt(((1 << 63) - 1) // dims) // 2


def _small(table: np.ndarray) -> np.ndarray:
    """The table in the narrowest integer type that holds it."""
    top = int(np.abs(table).max()) if table.size else 0
    return table.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def pack(table: np.ndarray) -> bytes:
    """A table of integers as bytes: the width of its numbers, then the numbers."""
    small = _small(table)
    return bytes([small.itemsize]) + small.tobytes()


def unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[data[0]], offset=1).astype(np.int64).reshape(-1, columns)


def lay_out(vectors: DataFrame, dims: int, width: int, id_col: str, vec_col: str, most: int = CHUNK) -> DataFrame:
    """The written table (chunk, block, ids, data): blocks of ``width`` columns of up to ``most`` vectors each, and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), most):
                b = batch.slice(at, most)
                flat = np.floor(SCALE * b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                if flat.size and np.abs(flat).max() > largest(dims):
                    raise ValueError(f"a component beyond {largest(dims) // SCALE} makes a squared distance that no long holds")
                table = flat.astype(np.int64).reshape(-1, dims)
                blocks = [pack(table[:, k : k + width]) for k in range(0, dims, width)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * (len(blocks) + 1), pa.int64()), pa.array([IDS, *range(len(blocks))], pa.int32()),
                        pa.array([b.column(0).to_pylist()] + [None] * len(blocks), pa.list_(pa.int64())), pa.array([None, *blocks], pa.binary()),
                    ],
                    names=["chunk", "block", "ids", "data"],
                )
                number += 1

    return materialise(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "chunk long, block int, ids array<bigint>, data binary"), "vector-blocks")


def usable(vectors: DataFrame, dims: int, vec_col: str) -> DataFrame:
    """The rows whose vector has ``dims`` components, none of them null or not finite."""
    v = F.col(vec_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.where((F.size(v) == dims) & F.forall(v, lambda x: finite(x.cast("double"))))


def first_centroids(vectors: DataFrame, k: int, seed: str, id_col: str, vec_col: str) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``seed`` and id, in that order; equal hashes by their components."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), F.transform(F.col(vec_col), lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("v"))
    return np.array([r["v"] for r in rows.orderBy("key", "v").limit(k).collect()], dtype=np.int64)


def _partial(table: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Squared distances over some columns, rows by centroids; by matrix product where doubles hold the sums exactly."""
    top = max(int(np.abs(table).max(initial=0)), int(np.abs(slices).max(initial=0)))
    if 4 * top * top * table.shape[1] < EXACT:
        x, c = table.astype(np.float64), slices.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((table - c) ** 2).sum(axis=1) for c in slices], axis=1)


def assign(blocks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """The written table (chunk, nearest, distance): for each vector of a chunk its centroid and squared distance, packed.

    Tasks over blocks of columns give partial distances; those of a chunk are
    added, and of equal distances the smallest centroid number wins.
    """
    k, dims = centroids.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                part = centroids[:, block * width : (block + 1) * width]
                far = _partial(unpack(data.as_py(), part.shape[1]), part)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(far)], pa.binary())], names=["chunk", "partial"])

    def add(table: pa.Table) -> pa.Table:
        far = sum(unpack(x.as_py(), k) for x in table.column("partial"))
        nearest = far.argmin(axis=1)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "nearest": pa.array([pack(nearest)], pa.binary()), "distance": pa.array([pack(far[np.arange(len(far)), nearest])], pa.binary())})

    partial = blocks.where(F.col("block") != IDS).select("chunk", "block", "data").mapInArrow(measure, "chunk long, partial binary")
    return materialise(partial.groupBy("chunk").applyInArrow(add, "chunk long, nearest binary, distance binary"), "nearest")


def moved(blocks: DataFrame, nearest: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after each shard has put the floor of its clusters' means into its own slice; empty clusters stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One table of sums a shard and task; a cluster's number of vectors goes with the first shard.
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data, near in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                columns = min(width, dims - block * width)
                table, at = unpack(data.as_py(), columns), unpack(near.as_py(), 1)[:, 0]
                total = own.setdefault(block, np.zeros((k, columns + 1), np.int64))
                order = np.argsort(at, kind="stable")
                present, starts = np.unique(at[order], return_index=True)
                total[present, :-1] += np.add.reduceat(table[order], starts, axis=0)
                total[:, -1] += np.bincount(at, minlength=k)
        for block, total in own.items():
            cluster, column = np.divmod(np.arange(total.size), total.shape[1])
            last = column == total.shape[1] - 1
            keep = ~last | (block == 0)
            where = np.where(last, dims, column + block * width)
            yield pa.RecordBatch.from_arrays([pa.array(cluster[keep], pa.int32()), pa.array(where[keep], pa.int32()), pa.array(total.ravel()[keep])], names=["cluster", "column", "total"])

    rows = blocks.where(F.col("block") != IDS).select("chunk", "block", "data").join(nearest.select("chunk", "nearest"), "chunk")
    added = rows.select("block", "data", "nearest").mapInArrow(sums, "cluster int, column int, total long").groupBy("cluster", "column").agg(F.sum("total").alias("total"))
    table = np.zeros((k, dims + 1), np.int64)
    # A number for each cluster and column, however many vectors there are.
    for r in added.collect():
        table[r["cluster"], r["column"]] = r["total"]
    size = table[:, dims:]
    return np.where(size > 0, table[:, :dims] // np.maximum(size, 1), centroids)


def _labels(blocks: DataFrame, nearest: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, near, far in zip(b.column(0), b.column(1), b.column(2)):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(unpack(near.as_py(), 1)[:, 0], pa.int32()), pa.array(unpack(far.as_py(), 1)[:, 0])], names=["vec_id", "cluster", "distance"])

    rows = blocks.where(F.col("block") == IDS).select("chunk", "ids").join(nearest, "chunk")
    return rows.select("ids", "nearest", "distance").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, width: int = 32, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding", most: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable vector, and the centroids.

    Vectors of another length or with a null or non-finite component, and null
    vectors, are left out. Rows of a null or repeated id are rows of their own
    and may all be first centroids; a null id is hashed as ''. Fewer than ``k``
    vectors give as many centroids; none give no rows. Equal distances go to
    the smaller number. Other columns are not read, whatever their names. A
    component so large that a squared distance would fit no long (beyond some
    700,000 in 64 dimensions) raises ValueError. The driver holds ``k`` times ``dims`` numbers.
    """
    fine = usable(vectors, dims, vec_col)
    centroids = first_centroids(fine, k, seed, id_col, vec_col)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, dims)
    blocks = lay_out(fine, dims, width, id_col, vec_col, most)
    for _ in range(rounds):
        centroids = moved(blocks, assign(blocks, centroids, width), centroids, width)
    return _labels(blocks, assign(blocks, centroids, width)), centroids


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, width: int = 32, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding", most: int = CHUNK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable vector; edge cases as in :func:`cluster_vectors`."""
    labels, centroids = cluster_vectors(vectors, k, rounds, dims, width, seed, id_col, vec_col, most)
    # A row for each of the k centroids.
    inertia = {r["cluster"]: r["inertia"] for r in labels.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digest(v)) for c, v in enumerate(centroids.tolist())]
    table = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

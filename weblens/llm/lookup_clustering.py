"""Centroid clustering of integer vectors by scalar lookup tables.

Lloyd rounds in exact integers. Every round tabulates (value - centroid)^2 for each
dimension, each integer value that occurs in it and each centroid; a vector's distances
are table rows gathered by its components and added up. Which values occur is found once,
by a distinct aggregation. Quantised components are few; where there are more than
``max_pairs`` (dimension, value) pairs, tasks tabulate the values of their own batch
instead, so what is sent to a task never grows with the data. Tasks add up their vectors
by cluster, so a round shuffles k rows a task, however large a cluster is.

Ties go to the centroid with the smaller number, means are rounded down, a centroid
without vectors stays. Repeated rows count as often as they occur. A null vec_id takes part,
but is the last choice as an initial centroid. With fewer than ``k`` vectors each is a
centroid of its own. Components beyond +-2^27 fail the job, as distances would not fit a
long. Other columns are ignored; an empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblens.llm.common import workspace

MAX_PAIRS = 1 << 16  # table of 64 MB at most for 128 centroids, 8 MB for 16
_LARGEST = 1 << 27
_ROWS = 2048

ASSIGNED = "vec_id long, cluster int, distance long"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of equal length as rows."""
    x = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    if x.size and (x.max() > _LARGEST or x.min() < -_LARGEST):
        raise ValueError(f"a component is beyond {_LARGEST}")
    return x


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part, _matrix(part)


def occurring(x: np.ndarray) -> list[np.ndarray]:
    """The sorted values of each dimension."""
    return [np.unique(column) for column in x.T]


def tabulate(values: list[np.ndarray], centroids: np.ndarray) -> list[np.ndarray]:
    """For each dimension the squared difference of each of its values and each centroid."""
    return [(v[:, None] - centroids[None, :, d]) ** 2 for d, v in enumerate(values)]


def distances(x: np.ndarray, values: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Squared distances (vector, centroid) as sums of table rows."""
    out = np.zeros((len(x), tables[0].shape[1]), np.int64)
    for d, table in enumerate(tables):
        out += table[np.searchsorted(values[d], x[:, d])]
    return out


def _nearest(batches, centroids: np.ndarray, values: list[np.ndarray] | None):
    """(batch, vectors, cluster, distance) of each part."""
    tables = values and tabulate(values, centroids)
    for part, x in _parts(batches):
        own = values or occurring(x)
        far = distances(x, own, tables or tabulate(own, centroids))
        cluster = far.argmin(axis=1)
        yield part, x, cluster, far[np.arange(len(x)), cluster]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, x in _parts(batches):
        found = occurring(x)
        dims = np.repeat(np.arange(len(found), dtype=np.int32), [len(v) for v in found])
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(np.concatenate(found))], names=["dim", "value"])


def _sums(centroids: np.ndarray, values: list[np.ndarray] | None):
    """(cluster, sums and number of its vectors), one row a cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, x, cluster, _ in _nearest(batches, centroids, values):
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            total[present, :-1] += np.add.reduceat(x[order], first, axis=0)
            total[:, -1] += np.bincount(cluster, minlength=len(centroids))
        held = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    return run


def _assignment(centroids: np.ndarray, values: list[np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _nearest(batches, centroids, values):
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, vector: array of long, all of one length).

    Columns: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    Initial centroids are the k vectors with the smallest sha256 of ``<seed>:<vec_id>``.
    The driver sees k centroids, k sums a round and the occurring values up to ``max_pairs``.
    """
    spark = vectors.sparkSession
    space = workspace(spark, "clustering")
    rows = space.table("rows", vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    if not first:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["vector"] for r in first], np.int64)

    pairs = rows.mapInArrow(_pairs, "dim int, value long").distinct().limit(max_pairs + 1).collect()
    values = None
    if len(pairs) <= max_pairs:
        values = [np.sort(np.array([p["value"] for p in pairs if p["dim"] == d], np.int64)) for d in range(centroids.shape[1])]

    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centroids, values), "cluster int, sums array<long>")
        sums = sums.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        totals: dict[int, dict[int, int]] = {}
        for r in sums.collect():  # k clusters of one row a dimension
            totals.setdefault(r["cluster"], {})[r["pos"]] = int(r["total"])
        for c, total in totals.items():
            count = total.pop(centroids.shape[1])
            centroids[c] = [total[d] // count for d in range(centroids.shape[1])]

    assigned = space.table("assigned", rows.mapInArrow(_assignment(centroids, values), ASSIGNED))
    by_cluster = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    inertia = sum(by_cluster.values())

    def of_cluster(items: dict) -> F.Column:
        return F.create_map(*[F.lit(x) for c, v in items.items() for x in (c, v)])[F.col("cluster")]

    return assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster(by_cluster).cast("long").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"),
        of_cluster({c: digest(centroids[c]) for c in by_cluster}).alias("centroid_sha256"),
    )

"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors on a few random orthogonal directions, shifts them and
orders them along a Hilbert curve. Spark range-partitions the keys and counts ranks;
the rows within a window of ranks around a query, a fixed share of the table, are its
candidates on that curve. Windows are looked at in blocks of bounded size, so a
larger table makes more tasks, not larger ones. The lists of all curves are merged,
and scores are inner products of the original vectors in double precision, summed in
the order of components, so that a pair has one score wherever it is found.

Of rows with the same vector only the k + 1 with the smallest ids can be among the k
nearest of any query, since ties go to the smaller id; the others are indexed as copies
of those, and are still queries. Vectors that are null, all zero, or hold null or
non-finite components, and null ids, take no part. A query id that repeats is asked
once, with its least vector, and its rows are no candidates for it. An empty table
gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.common import workspace
from weblens.llm.voronoi import matrix, ranked, usable

CURVES = 12
DIMENSIONS = 8
BITS = 7
WINDOW = 0.07  # share of the table on either side of a query, per curve
LEAST_WINDOW = 64
BLOCK = 8192
CHUNK_QUERIES = 4096
SEED = 20240607


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, d) below 2 ** bits, d * bits <= 62."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations and reflections of each level
        low = bit - 1
        for i in range(d):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[d - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def projections(size: int, curves: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (curves, size, dimensions) and shifts (curves, dimensions) in [0, 1)."""
    draw = np.random.default_rng(seed)
    wide = max(size, dimensions)
    directions = np.stack([np.linalg.qr(draw.normal(size=(wide, wide)))[0][:size, :dimensions] for _ in range(curves)])
    return directions, draw.random((curves, dimensions))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _keys(size: int, curves: int, dimensions: int, bits: int, seed: int):
    directions, shifts = projections(size, curves, dimensions, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _unit(matrix(part["vector"]).astype(np.float64))
                for curve in range(curves):
                    # unit vectors project into [-1, 1]; most lie near 0, within 4 / sqrt(size)
                    y = np.clip(x @ directions[curve] * np.sqrt(size) / 8 + 0.5, 0, 1) / 2 + shifts[curve] / 2
                    key = hilbert_keys(np.minimum(y * (1 << bits), (1 << bits) - 1).astype(np.int64), bits)
                    n = part.num_rows
                    columns = [pa.array(np.full(n, curve, np.int32)), pa.array(key), *(part[c] for c in ("vec_id", "vector", "is_query", "is_row"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["curve", "key", "vec_id", "vector", "is_query", "is_row"])

    return place


def in_order(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products whose terms are added one after another."""
    return np.cumsum(rows * query[None, :], axis=1)[:, -1]


def _search(k: int, window: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            x, ids, ranks = matrix(rows["vector"]).astype(np.float64), rows["vec_id"].to_numpy(), rows["pos"].to_numpy()
            q = matrix(queries["q_vector"]).astype(np.float64)
            for start in range(0, len(q), 256):
                some = q[start : start + 256]
                for own, at, vector, near in zip(queries["q_id"].iloc[start:], queries["q_pos"].iloc[start:], some, some @ x.T):
                    allowed = np.flatnonzero((np.abs(ranks - at) <= window) & (ids != own))
                    if len(allowed) > k:
                        values = near[allowed]
                        least = np.partition(values, len(values) - k)[len(values) - k]
                        allowed = allowed[values >= least - 1e-9 * (1 + abs(least))]
                    exact = in_order(vector, x[allowed])
                    first = np.lexsort((ids[allowed], -exact))[:k]
                    out.extend((own, ids[i], s) for i, s in zip(allowed[first], exact[first]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def search(
    vectors: DataFrame, is_query: Column, k: int, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS,
    window: float = WINDOW, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found among ``vectors`` (vec_id, vector of double)."""
    spark = vectors.sparkSession
    space = workspace(spark, "hilbert")
    good = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & good).select("vec_id", "vector")
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = len(first["vector"])
    same = Window.partitionBy("vector").orderBy("vec_id")
    # Rows that repeat id and vector are one result; of equal vectors the k + 1 smallest ids stand for all.
    kept = rows.distinct().withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "vector")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    marked = kept.withColumns({"is_query": F.lit(False), "is_row": F.lit(True)}).union(asked.withColumns({"is_query": F.lit(True), "is_row": F.lit(False)}))
    schema = "curve int, key long, vec_id long, vector array<double>, is_query boolean, is_row boolean"
    keyed = marked.mapInArrow(_keys(size, curves, dimensions, bits, seed), schema)
    # Written once in range order; a row's number in its partition makes its rank.
    ordered = keyed.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    ordered = space.table("ordered", ordered.withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = space.table("offsets", sizes.select("part", before.alias("offset"), "n"))
    total = offsets.agg(F.sum("n")).first()[0] // curves
    rank = F.col("offset") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("curve") * F.lit(total)
    placed = ordered.withColumn("part", part).join(offsets, "part").withColumn("pos", rank)
    wide = max(LEAST_WINDOW, int(window * total + 1))
    data = placed.where("is_row").select("curve", F.floor(F.col("pos") / block).cast("long").alias("block"), "pos", "vec_id", "vector")
    low = F.greatest(F.col("pos") - wide, F.lit(0))
    high = F.least(F.col("pos") + wide, F.lit(total - 1))
    met = F.explode(F.sequence(F.floor(low / block), F.floor(high / block)))
    # Queries that are neighbours on a curve are a chunk of bounded size; a block is copied to the chunks that meet it.
    asking = max(1, placed.where("is_query").count() // curves)
    span = max(1, CHUNK_QUERIES * total // asking)
    sent = placed.where("is_query").select(
        F.col("curve").alias("q_curve"), met.alias("q_block"), F.floor(F.col("pos") / span).alias("q_chunk"),
        F.col("pos").alias("q_pos"), F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"),
    )
    sent = space.table("sent", sent)
    pairs = space.table("pairs", sent.select(F.col("q_curve").alias("curve"), F.col("q_block").alias("block"), F.col("q_chunk").alias("chunk")).distinct())
    data = data.join(pairs, ["curve", "block"])
    pairs = sent.groupBy("q_curve", "q_block", "q_chunk").cogroup(data.groupBy("curve", "block", "chunk"))
    found = pairs.applyInPandas(_search(k, wide), "query_id long, vec_id long, score double")
    # A pair found on several curves has the same score; repeated rows count once per curve.
    return ranked(found.distinct(), k)

"""Voronoi kNN join: exact largest inner products, solved cell by cell.

Queries and rows are grouped by their nearest pivot; the number of pivots grows with the
root of the table. A group's summary holds its pivot, its number of rows, radii, norms and
widest angle, and the k + 1 rows nearest to the pivot. From the summaries alone a query
gets, for every group, an upper bound of its rows' scores, the least of three:

* q.p + |q| r for pivot p and radius r (Cauchy-Schwarz);
* |q| m cos(a - w) for the largest norm m, the angle a between q and p, the widest angle w;
* in the space where rows get one more coordinate so that all have the norm M, the nearest
  row is the one of largest score, and the triangle inequality bounds its distance.

The k-th best score among the summaries' own rows is one that the query reaches in any
case; only groups whose upper bound is not below it are searched. Neighbouring groups share
a cell of bounded size, and a group that is larger than a cell is cut, so one that holds a
third of all rows is many tasks. Queries go in chunks of neighbouring groups. Rows are
copied only to (cell, chunk) pairs that some query was sent to; there the wanted groups are
multiplied, and k rows a query are kept and merged.

Rows with equal vectors tie on every score, so of any number of them those with the k + 1
smallest ids stand for all: no result is lost.

Vectors that are null, or hold null or non-finite components, and rows with a null id
take no part. Ties go to the smaller id. Repeated rows are candidates as often as they
occur; a query id that repeats is asked once, with its least vector, and no row with
its id is a candidate for it. Vectors of unlike lengths fail the job. An empty table
gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.common import workspace

MAX_PIVOTS = 4096  # with their summaries some 12 MB at 64 dimensions
CELL_ROWS = 4096
CHUNK_QUERIES = 4096
_SENT = 1024  # queries in a batch sent on
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantize(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def matrix(column) -> np.ndarray:
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.array([np.asarray(r) for r in rows])


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles where every sum fits, else Python integers."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return (queries.astype(object) @ rows.astype(object).T).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle of each row of x with each row of y; a zero vector is at angle 0 of all."""
    sizes = _norms(x)[:, None] * _norms(y)[None, :]
    return np.arccos(np.clip(np.where(sizes > 0, x @ y.T / np.where(sizes > 0, sizes, 1), 1), -1, 1))


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of the nearest pivot of each row."""
    return ((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T).argmin(axis=1)


def _assign(pivots: np.ndarray, largest: float):
    """Group and distances of each row: to the pivot, to the lifted pivot, norm, angle."""
    height = np.sqrt(np.maximum(largest**2 - (pivots**2).sum(1), 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["vector"]).astype(np.float64)
            group = nearest(x, pivots)
            own, size = pivots[group], _norms(x)
            far = _norms(x - own)
            up = np.sqrt(np.maximum(largest**2 - size**2, 0)) - height[group]
            sizes = size * _norms(own)
            cosine = np.where(sizes > 0, (x * own).sum(axis=1) / np.where(sizes > 0, sizes, 1), 1)
            columns = [pa.array(group.astype(np.int32)), pa.array(far), pa.array(np.sqrt(far**2 + up**2)), pa.array(size), pa.array(np.arccos(np.clip(cosine, -1, 1)))]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], *columns], names=["vec_id", "vector", "grp", "far", "lifted", "norm", "angle"])

    return assign


class Summaries:
    """What is known of the groups; all arrays are by group, in the cells' order."""

    def __init__(self, pivots: np.ndarray, rows: pd.DataFrame, kept: pd.DataFrame, largest: float, k: int, cell_rows: int):
        centred = pivots - pivots.mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(1)
        rows = rows.iloc[np.lexsort((rows["grp"], along[rows["grp"]]))]
        self.k, self.largest = k, largest
        self.group = rows["grp"].to_numpy(np.int32)
        self.pivots = pivots[self.group]
        self.count, self.far, self.lifted, self.norm, self.angle = (rows[c].to_numpy() for c in ("n", "far", "lifted", "norm", "angle"))
        # cells: neighbouring groups up to cell_rows; a larger group is a cell of several pieces
        self.cell, self.pieces = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        held, cell = 0, 0
        for n, count in enumerate(self.count):
            if held and held + count > cell_rows:
                held, cell = 0, cell + 1
            self.cell[n], self.pieces[n] = cell, max(1, -(-int(count) // cell_rows))
            held += count
        self.kept_ids = kept["vec_id"].to_numpy(np.int64)
        self.kept = matrix(kept["vector"])

    def places(self) -> pd.DataFrame:
        """grp -> cell, pieces."""
        return pd.DataFrame({"grp": self.group, "cell": self.cell, "pieces": self.pieces})

    def upper(self, q: np.ndarray) -> np.ndarray:
        """No row of a group has a higher score than this (query, group)."""
        size, middle = _norms(q)[:, None], q @ self.pivots.T
        plain = middle + size * self.far[None, :]
        apart = np.maximum(_angles(q, self.pivots) - self.angle[None, :] - 1e-7, 0)
        wide = size * self.norm[None, :] * np.maximum(np.cos(apart), 0)
        away = np.sqrt(np.maximum(size**2 + self.largest**2 - 2 * middle, 0))
        lifted = (size**2 + self.largest**2 - np.maximum(away - self.lifted[None, :], 0) ** 2) / 2
        slack = 1e-6 * (1 + np.abs(middle) + size * self.largest + size**2 + self.largest**2)
        return np.minimum(np.minimum(plain, wide), lifted) + slack

    def wanted(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a query has to see a group (query, group)."""
        known = inner(q, self.kept)
        known[self.kept_ids[None, :] == ids[:, None]] = _NONE
        if known.shape[1] < self.k:
            return np.ones((len(q), len(self.group)), bool)
        reach = np.partition(known, known.shape[1] - self.k, axis=1)[:, known.shape[1] - self.k]
        enough = reach > _NONE
        return (self.upper(q.astype(np.float64)) >= reach[:, None]) | ~enough[:, None]


def _route(known: Summaries):
    """Sends each query to the cells that hold a group it has to see."""
    names = ["vec_id", "vector", "chunk", "groups", "cell", "piece"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.diff(known.cell, prepend=-1))
        end = np.append(begin[1:], len(known.cell))
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                wanted = known.wanted(matrix(part["vector"]), part["vec_id"].to_numpy())
                sent = [
                    (row, known.group[begin[c] : end[c]][wanted[row, begin[c] : end[c]]], c, piece)
                    for row, c in zip(*np.nonzero(np.logical_or.reduceat(wanted, begin, axis=1)))
                    for piece in range(known.pieces[begin[c]])
                ]
                for first in range(0, len(sent), _SENT):
                    rows, groups, cells, pieces = zip(*sent[first : first + _SENT])
                    columns = [part[name].take(pa.array(rows)) for name in names[:3]]
                    columns += [pa.array(list(groups), pa.list_(pa.int32())), pa.array(cells, pa.int64()), pa.array(pieces, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return route


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best candidates, ties to the smaller id, the query's own id left out."""
    allowed = np.flatnonzero((ids != own) & (scores > _NONE))
    if len(allowed) > k:
        values = scores[allowed]
        least = np.partition(values, len(values) - k)[len(values) - k]
        allowed = allowed[values >= least]
    return allowed[np.lexsort((ids[allowed], -scores[allowed]))][:k]


def _solve(k: int):
    """Multiplies each wanted group of a cell with the queries that want it."""

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("grp", kind="stable")
            x, ids, groups = matrix(rows["vector"]), rows["vec_id"].to_numpy(), rows["grp"].to_numpy()
            begin = np.flatnonzero(np.diff(groups, prepend=-1))
            end = np.append(begin[1:], len(groups))
            for start in range(0, len(queries), 256):
                some = queries.iloc[start : start + 256]
                q = matrix(some["vector"])
                scores = np.full((len(some), len(x)), _NONE, np.int64)
                wants = [set(g.tolist()) for g in some["groups"]]
                for a, b in zip(begin, end):
                    asking = [n for n, w in enumerate(wants) if groups[a] in w]
                    if asking:
                        scores[asking, a:b] = inner(q[asking], x[a:b])
                for own, found in zip(some["vec_id"], scores):
                    out.extend((own, ids[i], found[i]) for i in best(found, ids, own, k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return solve


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all cells."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunks(known: Summaries, homes: dict[int, int], chunk: int) -> pd.DataFrame:
    """grp -> first chunk and number of chunks of its queries; neighbouring groups share one."""
    first, parts, held, number = [], [], 0, 0
    for group in known.group:
        n = homes.get(int(group), 0)
        if held and held + n > chunk:
            held, number = 0, number + 1
        pieces = max(1, -(-n // chunk))
        first.append(number)
        parts.append(pieces)
        held, number = (held + n, number) if pieces == 1 else (0, number + pieces)
    return pd.DataFrame({"home": known.group, "first": first, "parts": parts})


def knn_join(vectors: DataFrame, is_query: Column, k: int, pivots: int | None = None, cell_rows: int = CELL_ROWS, chunk: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of ``vectors`` (vec_id, vector of long).

    ``pivots`` is the root of the number of rows by default, at most ``MAX_PIVOTS``.
    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    space = workspace(spark, "voronoi")
    every = space.table("every", vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector"))
    order = Window.partitionBy("vector").orderBy("vec_id")
    once = every.groupBy("vector", "vec_id").agg(F.count("*").alias("times")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    copies = F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int")))
    rows = space.table("rows", once.select("vec_id", "vector", copies.alias("copy")).drop("copy"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, largest = rows.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pivots or min(MAX_PIVOTS, max(16, int(np.ceil(total**0.5))))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(pivots).select("vector").collect()
    points = np.unique(np.array([r["vector"] for r in chosen], np.float64), axis=0)

    schema = "vec_id long, vector array<long>, grp int, far double, lifted double, norm double, angle double"
    placed = space.table("placed", rows.mapInArrow(_assign(points, largest), schema))
    summary = placed.groupBy("grp").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("far", "lifted", "norm", "angle")])
    close = Window.partitionBy("grp").orderBy("far", "vec_id", "vector")
    kept = placed.withColumn("n", F.row_number().over(close)).where(F.col("n") <= k + 1).select("vec_id", "vector")
    known = Summaries(points, summary.toPandas(), kept.toPandas(), largest, k, cell_rows)  # a line and k + 1 rows a pivot

    queries = every.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                group = nearest(matrix(batch["vector"]).astype(np.float64), points)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], pa.array(group.astype(np.int32))], names=["vec_id", "vector", "home"])

    queries = space.table("queries", queries.mapInArrow(home, "vec_id long, vector array<long>, home int"))
    homes = {r["home"]: r["count"] for r in queries.groupBy("home").count().collect()}  # one row a pivot
    # A query's home may be a group without rows: its pivot's rows were all nearer to another.
    chunks = F.broadcast(spark.createDataFrame(_chunks(known, homes, chunk), "home int, first long, parts long"))
    number = F.coalesce(F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0)).alias("chunk")
    queries = queries.join(chunks, "home", "left").select("vec_id", "vector", number)
    schema = "vec_id long, vector array<long>, chunk long, groups array<int>, cell long, piece long"
    sent = space.table("sent", queries.mapInArrow(_route(known), schema))
    pairs = space.table("pairs", sent.select("cell", "piece", "chunk").distinct())
    places = F.broadcast(spark.createDataFrame(known.places(), "grp int, cell long, pieces long"))
    data = placed.select("vec_id", "vector", "grp").join(places, "grp").withColumn("piece", F.pmod(F.xxhash64("vec_id", "vector"), "pieces"))
    data = data.join(pairs, ["cell", "piece"]).select("vec_id", "vector", "grp", "cell", "piece", "chunk")
    keys = ["cell", "piece", "chunk"]
    found = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    return ranked(found, k)

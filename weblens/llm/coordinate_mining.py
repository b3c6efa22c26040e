"""Hard negatives by coordinate pruning over length buckets.

Rows are put in buckets of similar length (each bucket's lengths differ by a tenth at
most) and groups of labels, cut into blocks of bounded size. A block keeps, for each
coordinate, its directions (vectors divided by their length) as a sorted list. For an
anchor of direction q and a score bound t, a row of a bucket with lengths up to m can
reach the bound only if the angle between both is at most phi = acos(t / (|q| m)); then
for every coordinate f its value lies in [cos(a + phi), cos(a - phi)], where a = acos(q_f).
For the anchor's focus coordinates (those with the largest values) these feasible ranges
are looked up in the sorted lists; the rows in all of them are verified by exact integer
inner products. An anchor goes only to blocks whose longest row could reach its bound.

Bounds come from pilot rows, a bounded hash sample that every anchor is compared with:
the k-th best of some rows is never above the k-th best of all, so no result is lost,
whatever the pilot rows are.

Two searches follow each other: an anchor's first positives among the rows of its label,
then, for each (anchor, positive), the best rows of other labels whose score lies in a
band of shares of the positive's score.

Rows that are equal in label and vector tie with each other on every score, so of any
number of them those with the k + 1 smallest ids stand for all (k: the longest result
asked for): the hot group that holds a third of all rows shrinks without losing a result.

Rows with a null id or label, and null or empty vectors, take no part; null and non-finite
components are for the caller to leave out. Rows whose id is the anchor's own are no
"other" rows. Repeated rows are results as often as they occur; an anchor id that
repeats is one anchor, with its least label and vector. Vectors of unlike lengths do not
meet. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.common import workspace

RATIO = 1.1  # longest to shortest length in a bucket
LABEL_GROUPS = 64
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 1024
PILOT_ROWS = 2048  # rows sent to each routing task
FOCUS = 4
_SENT = 1024  # anchors in a batch sent on
_EXACT = float(1 << 53)
_SLACK = 1e-9


def matrix(column) -> np.ndarray:
    """Vectors of one length, as rows."""
    return np.array([np.asarray(v, np.int64) for v in column], np.int64)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows with one vector; in doubles where every sum fits."""
    if not len(x):
        return np.zeros(0, np.int64)
    if float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < _EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return (x.astype(object) @ q.astype(object)).astype(np.int64)


def first(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest values, ties by smaller id."""
    some = np.arange(len(values))
    if len(values) > k:
        some = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    return some[np.lexsort((ids[some], -values[some]))][:k]


class Block:
    """The rows of a block with their sorted coordinate lists, made when first used."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.wide = x.astype(np.float64)
        self.length = np.sqrt((self.wide**2).sum(axis=1))
        self.zero = self.length == 0
        self.direction = self.wide / np.where(self.zero, 1, self.length)[:, None]
        self.longest = float(self.length.max()) if len(x) else 0.0
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.small = float(np.abs(self.wide).max()) if x.size else 0.0

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, rows) of coordinate f, by value."""
        if f not in self.lists:
            order = np.argsort(self.direction[:, f], kind="stable")
            self.lists[f] = self.direction[order, f], order
        return self.lists[f]

    def candidates(self, q: np.ndarray, bound: float, focus: int = FOCUS) -> np.ndarray:
        """Rows that may have an inner product of ``bound`` or more with q."""
        size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        if not size or not self.longest or bound <= 0:
            return np.arange(len(self.x))
        cosine = bound / (size * self.longest)
        if cosine > 1 + _SLACK:
            return np.zeros(0, np.int64)
        phi = float(np.arccos(min(cosine, 1.0))) + 1e-7  # near 1 an error of 1e-15 is one of 4e-8 in the angle
        unit = q / size
        chosen = np.argsort(-np.abs(unit), kind="stable")[:focus]
        hits = np.zeros(len(self.x), np.int8)
        for f in chosen:
            angle = float(np.arccos(np.clip(unit[f], -1, 1)))
            low = np.cos(min(angle + phi, np.pi)) - _SLACK
            high = np.cos(max(angle - phi, 0.0)) + _SLACK
            values, order = self.sorted(int(f))
            hits[order[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]] += 1
        return np.flatnonzero(hits == len(chosen))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        if self.small * float(np.abs(q).max(initial=0)) * self.x.shape[1] >= _EXACT:
            return scores(self.x[rows], q)
        wide = q.astype(np.float64)
        found = (self.wide @ wide)[rows] if 2 * len(rows) > len(self.x) else self.wide[rows] @ wide
        return found.astype(np.int64)


# --- the two kinds of question an anchor asks of a set of rows ----------------


def ask_positives(k: int):
    """questions(anchor) -> [(pos, same label?, lowest, highest score)]; here one, without a band."""

    def questions(anchor) -> list[tuple[int, bool, int | None, int | None]]:
        return [(0, True, None, None)]

    return questions, k


def ask_negatives(k: int, low: int, high: int):
    """One question for each positive: low * ps <= 100 * score <= high * ps."""

    def questions(anchor) -> list[tuple[int, bool, int | None, int | None]]:
        return [(n, False, -(-low * p // 100), high * p // 100) for n, p in enumerate(anchor.scores) if low * p <= high * p]

    return questions, k


def answer(values, ids, labels, anchor_id, label, question, k):
    """Positions of a question's k first rows."""
    _, same, lowest, highest = question
    keep = (ids != anchor_id) & ((labels == label) == same)
    if lowest is not None:
        keep &= (values >= lowest) & (values <= highest)
    rows = np.flatnonzero(keep)
    return rows[first(values[rows], ids[rows], k)]


def _route(summary: pd.DataFrame, pilot: pd.DataFrame, ask):
    """Sends each anchor with its questions' bounds to the blocks that could answer one of them."""
    questions, k = ask

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {n: (matrix(g["vector"]), g["vec_id"].to_numpy(), g["label"].to_numpy()) for n, g in pilot.groupby("dim")}
        groups = {n: g for n, g in summary.groupby("dim")}
        names = ["vec_id", "label", "vector", "scores", "bounds", "bucket", "part", "piece"]
        out: list[tuple] = []
        for frame in frames:
            for anchor in frame.itertuples():
                q = np.asarray(anchor.vector, np.int64)
                if len(q) not in groups:
                    continue
                group = groups[len(q)]
                size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
                x, ids, labels = known.get(len(q), (np.zeros((0, len(q)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                seen = scores(x, q)
                bounds, wanted = [], np.zeros(len(group), bool)
                for question in questions(anchor):
                    at = answer(seen, ids, labels, anchor.vec_id, anchor.label, question, k)
                    lowest = question[2] if question[2] is not None else -(1 << 62)
                    bound = max(lowest, int(seen[at[-1]])) if len(at) == k else lowest
                    bounds.append(bound)
                    reach = size * group["far"].to_numpy() * (1 + _SLACK) + _SLACK >= bound
                    if question[1]:
                        reach &= group["part"].to_numpy() == anchor.part
                    wanted |= reach
                for bucket, part, pieces in group.loc[wanted, ["bucket", "part", "pieces"]].itertuples(index=False):
                    for piece in range(pieces):
                        out.append((anchor.vec_id, anchor.label, anchor.vector, list(anchor.scores), bounds, bucket, part, piece))
                        if len(out) == _SENT:
                            yield pd.DataFrame(out, columns=names)
                            out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def _solve(ask):
    questions, k = ask

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            block, ids, labels = Block(matrix(rows["vector"])), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for anchor in anchors.itertuples():
                q = np.asarray(anchor.vector, np.int64)
                asked = questions(anchor)
                if not asked:
                    continue
                some = block.candidates(q, float(min(anchor.bounds)))
                values = block.scores(some, q)
                for question, bound in zip(asked, anchor.bounds):
                    best = answer(values, ids[some], labels[some], anchor.vec_id, anchor.label, question, k)
                    out += [(anchor.vec_id, question[0], ids[some[i]], values[i]) for i in best if values[i] >= bound]
        return pd.DataFrame(out, columns=["anchor_id", "pos", "vec_id", "score"]).astype("int64")

    return run


def _search(space, rows: DataFrame, anchors: DataFrame, summary: pd.DataFrame, pilot: pd.DataFrame, ask, name: str) -> DataFrame:
    """anchor_id, pos, rank, vec_id, score: the first rows of each question of ``anchors`` (vec_id, label, part, vector, scores)."""
    k = ask[1]
    schema = "vec_id long, label long, vector array<long>, scores array<long>, bounds array<long>, bucket int, part int, piece long"
    sent = anchors.mapInPandas(_route(summary, pilot, ask), schema)
    chunks = max(1, -(-anchors.count() // CHUNK_ANCHORS))
    sent = space.table(f"sent-{name}", sent.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))))
    # Data rows are copied only to the (block, chunk) groups that some anchor was sent to.
    block = ["dim", "bucket", "part", "piece"]
    sent = sent.withColumn("dim", F.size("vector"))
    groups = space.table(f"groups-{name}", sent.select(*block, "chunk").distinct())
    data = rows.join(groups, block)
    keys = [*block, "chunk"]
    found = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_solve(ask), "anchor_id long, pos long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "pos").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return space.table(f"found-{name}", found)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    block_rows: int = BLOCK_ROWS, pilot_rows: int = PILOT_ROWS,
) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, label, vector: array of long).

    For each anchor (rows where ``is_anchor``, a condition on vec_id) and each of its first ``positives`` other rows
    of the same label, the first ``negatives`` rows of other labels whose score is between
    ``low`` and ``high`` percent of the positive's. Columns: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    space = workspace(spark, "mining")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
    usable = usable.where("vec_id is not null and label is not null and size(vector) > 0")
    usable = space.table("usable", usable)

    # Equal rows: the smallest ids of each (label, vector), each at most as often as a result can hold it.
    most = max(positives, negatives)
    order = Window.partitionBy("label", "vector").orderBy("vec_id")
    once = usable.groupBy("label", "vector", "vec_id").agg(F.count("*").alias("times"))
    once = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + 1)
    once = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(most)).cast("int"))))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bucket = F.when(squares > 0, F.floor(F.log(squares) / F.lit(2 * float(np.log(RATIO))))).otherwise(-1).cast("int")
    part = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    rows = once.select("vec_id", "label", "vector", F.size("vector").alias("dim"), bucket.alias("bucket"), part.alias("part"), F.sqrt(squares).alias("far"))
    rows = space.table("rows", rows)

    # One line a bucket and label group, of which the doubles' range allows some thousands.
    summary = rows.groupBy("dim", "bucket", "part").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()
    summary["pieces"] = (-(-summary["n"] // block_rows)).astype("int64")
    pieces = spark.createDataFrame(summary[["dim", "bucket", "part", "pieces"]], "dim int, bucket int, part int, pieces long") if len(summary) else None
    if pieces is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = rows.drop("far").join(F.broadcast(pieces), ["dim", "bucket", "part"])
    placed = space.table("placed", placed.withColumn("piece", F.pmod(F.xxhash64("vec_id", "vector"), F.col("pieces"))).drop("pieces"))
    pilot = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label", "vector").limit(pilot_rows).select("vec_id", "label", "vector", "dim").toPandas()

    anchors = usable.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.*")
    anchors = space.table("anchors", anchors.withColumn("part", part))
    plain = anchors.withColumn("scores", F.array().cast("array<long>"))
    near = _search(space, placed, plain, summary, pilot, ask_positives(positives), "positive")

    chosen = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    chosen = chosen.select(F.col("anchor_id").alias("vec_id"), F.col("p.score").alias("scores"))
    asking = space.table("asking", anchors.join(chosen, "vec_id"))
    far = _search(space, placed, asking, summary, pilot, ask_negatives(negatives, low, high), "negative")

    near = near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("pos"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.select("anchor_id", "pos", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "pos"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

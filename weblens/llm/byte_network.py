"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte has a learned embedding; learned filters slide over it in steps of two, and a
rectifier follows. The text is cut into overlapping chunks that cover all of it, each
filter's maximum is taken in each chunk, and the mean and the maximum over the chunks
go into one logistic output. Learning runs on the driver on a bounded sample of labelled
rows, whole texts; scoring runs in the tasks. Both go through a text in blocks of chunks: of
a block only each filter's maximum and, when learning, the bytes under it are kept.

A null or empty text is one chunk of padding and gets a score. Repeated rows get equal
scores; an empty table gives an empty result. Labels that are null are ignored, repeated
ones count by their least value; without labels of both kinds the score is the share of
label 1 (0.5 without any). Only the text is an input of a score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.common import slices, workspace

CHUNK = 512  # new bytes of a chunk; it also holds WIDTH - STRIDE bytes of the next
WIDTH = 8
STRIDE = 2
EMBEDDING = 6
FILTERS = 16
SAMPLE = 4000  # labelled documents used for learning, half of each label if there are enough
BLOCK = 128  # chunks worked on at once
EPOCHS = 10
RATE = 0.01
SEED = 11
_PAD = 256


def count_chunks(data: np.ndarray) -> int:
    return max(1, -(-len(data) // CHUNK))


def blocks(texts: list[np.ndarray], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, text of each): the overlapping chunks of all texts, padded at a text's end, ``size`` at a time."""
    held, owners, n = [], [], 0
    for number, data in enumerate(texts):
        total, at = count_chunks(data), 0
        while at < total:
            take = min(total - at, size - n)
            part = data[at * CHUNK : (at + take) * CHUNK + WIDTH - STRIDE]
            padded = np.full(take * CHUNK + WIDTH - STRIDE, _PAD, np.int16)
            padded[: len(part)] = part
            held.append(padded[(np.arange(take) * CHUNK)[:, None] + np.arange(CHUNK + WIDTH - STRIDE)[None, :]])
            owners.append(np.full(take, number))
            at, n = at + take, n + take
            if n == size:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(owners)


class ByteNetwork:
    def __init__(self, draw: np.random.Generator, bias: float = 0.0):
        f = np.float32
        self.embedding = draw.normal(0, 0.5, (257, EMBEDDING)).astype(f)
        self.filters = draw.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH * EMBEDDING, FILTERS)).astype(f)
        self.offsets = np.zeros(FILTERS, f)
        self.output = np.zeros(2 * FILTERS, f)
        self.bias = np.array([bias], f)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offsets, self.output, self.bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maximum, its position) of each filter in each chunk."""
        wide = self.embedding[x].reshape(len(x), -1)
        positions = CHUNK // STRIDE
        step = wide.strides[1] * EMBEDDING * STRIDE
        windows = np.lib.stride_tricks.as_strided(wide, (len(x), positions, WIDTH * EMBEDDING), (wide.strides[0], step, wide.strides[1]))
        values = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBEDDING) @ self.filters
        values = values.reshape(len(x), positions, FILTERS)
        at = values.argmax(axis=1)
        top = np.take_along_axis(values, at[:, None, :], 1)[:, 0] + self.offsets
        return np.maximum(top, 0), at

    def features(self, texts: list[np.ndarray], keep: list | None = None) -> np.ndarray:
        """Mean and maximum of each filter's chunk maxima, per text."""
        sizes = np.array([count_chunks(t) for t in texts])
        means, tops = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS))
        for x, owner in blocks(texts):
            pooled, at = self.pooled(x)
            np.add.at(means, owner, pooled)
            np.maximum.at(tops, owner, pooled)
            if keep is not None:
                under = at[:, :, None] * STRIDE + np.arange(WIDTH)
                keep.append((pooled, x[np.arange(len(x))[:, None, None], under], owner))
        return np.concatenate([means / sizes[:, None], tops], axis=1)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 of each text."""
        logits = self.features(texts) @ self.output.astype(np.float64) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def learn(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork:
    """Fit by Adam on weighted log loss; gradients pass through each filter's maximum."""
    draw = np.random.default_rng(seed)
    share = min(max(float((labels * weights).sum() / max(weights.sum(), 1e-9)) if len(labels) else 0.5, 0.01), 0.99)
    net = ByteNetwork(draw, float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        return net
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    sizes = np.array([count_chunks(t) for t in texts])
    turn, size = 0, 32
    for epoch in range(epochs):
        order = draw.permutation(len(texts))
        for start in range(0, len(order), size):
            some = order[start : start + size]
            kept: list = []
            features = net.features([texts[i] for i in some], kept).astype(np.float32)
            pooled, codes, owner = (np.concatenate(c) for c in zip(*kept))
            tops = features[:, FILTERS:]
            p = 1 / (1 + np.exp(-np.clip(features @ net.output + net.bias[0], -30, 30)))
            error = ((p - labels[some]) * weights[some] / len(some)).astype(np.float32)
            back = error[:, None] * net.output[None, :]
            slope = back[owner, :FILTERS] / sizes[some][owner, None] + back[owner, FILTERS:] * (pooled == tops[owner])
            slope = (slope * (pooled > 0)).astype(np.float32)
            g_filters, g_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
            for f in range(FILTERS):
                live = np.flatnonzero(slope[:, f])
                patches = net.embedding[codes[live, f]].reshape(len(live), WIDTH * EMBEDDING)
                g_filters[:, f] = slope[live, f] @ patches
                np.add.at(g_embedding, codes[live, f], slope[live, f][:, None, None] * net.filters[:, f].reshape(1, WIDTH, EMBEDDING))
            gradients = [g_embedding, g_filters, slope.sum(0), features.T @ error + 1e-4 * net.output, np.array([error.sum()])]
            turn += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for value, gradient, m, v in zip(net.parameters(), gradients, first, second):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient * gradient - v)
                value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return net


def _array(text) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", sample: int = SAMPLE) -> ByteNetwork:
    """Learn from at most ``sample`` documents; ``allowed`` says of ``labels`` rows which may be used.

    The rows are those with the smallest hashes of their ids, up to half of each label.
    Losses are weighted so that scores follow the labels' shares among all allowed rows.
    """
    given = labels.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    shares = {int(r["y"]): r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    space = workspace(docs.sparkSession, "network")
    draw = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = given.where(F.col("y").isin(0, 1)).withColumn("n", F.row_number().over(draw)).where(F.col("n") <= sample // 2)
    chosen = space.table("chosen", chosen.select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y")))
    # At most ``sample`` ids, so the texts are found in the scan; of texts under one id the one with the least hash.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).groupBy("id", "y")
    rows = found.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("id").collect()
    y = np.array([r["y"] for r in rows], float)
    counts = {v: max(int((y == v).sum()), 1) for v in (0, 1)}
    weights = np.array([shares[int(v)] / counts[int(v)] for v in y])
    weights = weights / weights.mean() if len(weights) else weights
    return learn([_array(r["text"]) for r in rows], y, weights)


def score(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = [np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8) for v in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(net.score(texts))], schema=schema)

    workspace(docs.sparkSession, "network")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")

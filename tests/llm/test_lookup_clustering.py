"""Clustering by lookup tables against plain Lloyd rounds in Python integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens.llm import lookup_clustering

SCHEMA = "vec_id long, vector array<long>"


def brute(rows, k, rounds):
    def key(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centroids = [list(v) for _, v in sorted(rows, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in rows:
            members.setdefault(nearest(v)[1], []).append(v)
        for c, vs in members.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *reversed(nearest(v))) for i, v in rows]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), shas[c]) for i, c, d in found))


def got(spark, rows, **options):
    out = lookup_clustering.cluster(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


@pytest.mark.parametrize("max_pairs", [1 << 16, 5])
def test_equals_plain_rounds(spark, max_pairs):
    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(-6, 6, 8).tolist()) for i in range(120)]
    rows += [(500, [9] * 8)] * 60 + [(7, rows[7][1]), (None, [1] * 8), (None, [-3] * 8)]  # a third are copies, ids repeat
    assert got(spark, rows, k=6, rounds=3, max_pairs=max_pairs) == brute(rows, 6, 3)


def test_few_vectors_and_ties(spark):
    rows = [(1, [0, 0]), (2, [2, 0]), (3, [1, 0])]
    assert got(spark, rows, k=16, rounds=3) == brute(rows, 16, 3)
    rows = [(i, [5, 5]) for i in range(20)]
    out = got(spark, rows, k=4, rounds=2)
    assert {r[2] for r in out} == {0} and out == brute(rows, 4, 2)


def test_empty_extra_columns_and_wide_values(spark):
    assert lookup_clustering.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(1, [3, -4]), (2, [1 << 27, 0])], SCHEMA)
    clashing = frame.select("*", *[F.lit(1).alias(c) for c in ("cluster", "distance", "key", "dim", "value", "sums", "pos", "col")])
    assert sorted(r.distance for r in lookup_clustering.cluster(clashing, k=1, rounds=0).collect()) == [0, ((1 << 27) - 3) ** 2 + 16]
    with pytest.raises(Exception, match="beyond"):
        lookup_clustering.cluster(spark.createDataFrame([(1, [1 << 28])], SCHEMA)).collect()

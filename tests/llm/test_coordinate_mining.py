"""Hard negatives by coordinate pruning against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblens.llm import coordinate_mining as mining

SCHEMA = "vec_id long, label long, vector array<long>"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, step, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in rows if None not in r and len(r[2])]
    out = []
    for anchor in sorted({r[0] for r in rows if r[0] % step == 0}):
        label, q = min((r[1], r[2]) for r in rows if r[0] == anchor)

        def first(keep, k):
            scored = [(-sum(a * b for a, b in zip(q, v)), i) for i, l, v in rows if i != anchor and len(v) == len(q) and keep(l)]
            return scored, k

        same, _ = first(lambda l: l == label, positives)
        other, _ = first(lambda l: l != label, negatives)
        for s, p in sorted(same)[:positives]:
            band = sorted(x for x in other if low * -s <= 100 * -x[0] <= high * -s)
            out += [(anchor, p, n + 1, i, -s, -x) for n, (x, i) in enumerate(band[:negatives])]
    return sorted(out)


def got(spark, rows, step, **options):
    out = mining.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0, **options)
    assert out.columns == OUT
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("pilot", [1, 64])
def test_equals_all_pairs(spark, pilot):
    draw = np.random.default_rng(pilot)
    centres = draw.normal(0, 40, (8, 6))
    rows = []
    for i in range(260):  # clusters of several lengths, so that buckets and ranges prune
        v = (centres[i % 8] + draw.normal(0, 6, 6)) * (1, 1, 4, 30)[i % 4]
        rows.append((i, int(draw.integers(0, 4)), [int(x) for x in v]))
    rows += [(1000 + i, 1, [200, 10, -30, 4, 9, 77]) for i in range(130)]  # a third are copies
    rows += [(20, 2, [5] * 6), (20, 0, [9] * 6), (33, *rows[33][1:]), (33, *rows[33][1:])]  # ids and rows repeat
    rows += [(2000, 1, [0] * 6), (2001, 2, [0] * 6), (None, 1, [1] * 6), (2002, None, [1] * 6), (2003, 1, None), (2004, 1, []), (2010, 1, [7, 7]), (2011, 1, [8, 7]), (2012, 2, [3, 3])]
    assert got(spark, rows, 10, block_rows=32, pilot_rows=pilot) == brute(rows, 10)


def test_own_rows_never_hide_others(spark):
    rows = [(0, 1, [4, 4])] * 30 + [(i, i % 2, [4, 4 - i % 3]) for i in range(1, 25)]
    assert got(spark, rows, 100) == brute(rows, 100)


def test_empty_and_clashing_names(spark):
    assert mining.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    rows = [(i, i % 3, [i % 5, 3, i % 7]) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clashing = frame.select("*", *[F.lit(1).alias(c) for c in ("bucket", "part", "piece", "dim", "far", "n", "times", "chunk", "rank", "pos")])
    out = sorted(tuple(r) for r in mining.mine(clashing, F.col("vec_id") % 10 == 0).collect())
    assert out == brute(rows, 10)


def test_ranges_prune_clusters_and_lose_nothing():
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 100, (50, 16))
    x = np.repeat(centres, 40, axis=0) + draw.normal(0, 8, (2000, 16))
    x = np.array(x / np.sqrt((x**2).sum(axis=1, keepdims=True)) * draw.uniform(2000, 2190, (2000, 1)), np.int64)  # one length bucket
    block, kept = mining.Block(x), 0
    for q in x[::100]:
        values = x @ q
        bound = float(np.sort(values)[-10])
        some = block.candidates(q, bound)
        assert set(np.flatnonzero(values >= bound)) <= set(some)
        kept += len(some)
    assert kept < 0.3 * len(x) * 20, kept / len(x) / 20
    wide = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    assert mining.scores(wide, np.array([1 << 20, 7])).tolist() == [(1 << 60) + 21, -(1 << 60) + 35]

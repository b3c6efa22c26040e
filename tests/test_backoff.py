"""The full backoff rule: summaries of chunks against walking through every answer."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weblens.functions.retry import LATEST_US, backoff_step
from weblens.operators import backoff
from weblens.schemas import FETCH_LOG

START = datetime(2024, 1, 1)
EPOCH = datetime(1970, 1, 1)


def random_answers(rng, n, kinds):
    at, times = 1, []
    for _ in range(n):
        at += rng.choice([0, 1, 10**5, 10**6, 3 * 10**6, 4 * 10**7])
        times.append(at)
    return times, [rng.choice(kinds) for _ in range(n)]


def test_summaries_are_the_chunks_as_functions():
    rng = random.Random(1)
    for turn in range(4000):
        times, kinds = random_answers(rng, rng.randint(0, 14), [0, 1, 1, 2, 2, 3] if turn % 3 else [0, 1, 2])
        summary = backoff.summarise(times, kinds)
        for state in [(0, 0), (1, 1), (2, 10**6), (4, 5 * 10**6), (5, 3 * 10**7), (9, 10**9), (3, rng.randint(0, 10**8)), (2, LATEST_US)]:
            want = state
            for t, k in zip(times, kinds):
                want = backoff.step(want, t, k)
            assert backoff.after(*state, summary) == want


def test_summaries_stay_short():
    # One interval a failure at most, two numbers each but for the first few.
    times = [10_000 * i for i in range(10_000)]
    fails, _, breaks, ends, _, _ = backoff.summarise(times, [1] * len(times))
    assert fails == 10_000 and len(breaks) <= 10_000 and len(ends) <= len(breaks) + 30
    sparse = backoff.summarise([60_000_000 * i for i in range(10_000)], [1] * 10_000)
    assert len(sparse[2]) <= 7  # waits that end before the next failure meet at once
    # Endless rate limits: the wait grows to the last moment and stays there.
    state = (0, 0)
    for t in times[:200]:
        state = backoff.step(state, t, 2)
    assert state == (200, LATEST_US) == backoff.after(0, 0, backoff.summarise(times[:200], [2] * 200))


def test_a_hot_host_in_any_chunks(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        status = rng.choice([200, 404, 429, 429, 500, 500, 500, 0, None]) if i % 300 > 20 else 429
        host = "hot" if rng.random() < 0.5 else rng.choice("abc")
        rows.append((host, f"u{i}", START + timedelta(milliseconds=rng.choice([5, 400, 1500]) * i), i % 3, status, "x" if status == 0 else None))
    rows += [rows[5], rows[5], (None, "u", START, 0, 200, None), ("a", "u", None, 0, 500, None)]
    rng.shuffle(rows)
    state, want = {}, []
    for row in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1], r[3])):
        host, url, ts, attempt, status, error = row
        failed = error is not None or status in (429, 500, 502, 503, 504)
        us = (ts - EPOCH) // timedelta(microseconds=1)
        state[host] = backoff_step(*state.get(host, (0, 0)), us, status, failed)
        want.append((host, url, us, state[host][0], state[host][1] or None))
    log = spark.createDataFrame(rows, FETCH_LOG)
    for seconds in (3, 300):
        out = backoff.host_backoff(log, seconds)
        assert out.columns == [*log.columns, "fails", "backoff_until"]
        got = out.where("host is not null and ts is not null").select("host", "url", F.unix_micros("ts"), "fails", F.unix_micros("backoff_until")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert out.where("fails is null").count() == 2


def test_empty_log(spark):
    assert backoff.host_backoff(spark.createDataFrame([], FETCH_LOG)).count() == 0

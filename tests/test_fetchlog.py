import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weblens.functions import retry
from weblens.operators import fetchlog
from weblens.schemas import FETCH_LOG

START = datetime(2024, 1, 1)
RETRYABLE = {429, 500, 502, 503, 504}


def make_log(spark, rows):
    return spark.createDataFrame(rows, FETCH_LOG)


def random_rows(n, seed, spread_seconds):
    """Log in which one host has over a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = "hot.example" if rng.random() < 0.4 else f"h{rng.randrange(6)}.example"
        status = rng.choice([200, 200, 404, 429, 500, 503, 0])
        error = "reset" if status == 0 else None
        ts = START + timedelta(microseconds=rng.randrange(spread_seconds * 1_000_000))
        rows.append((host, f"https://{host}/{i}", ts, 0, status, error))
    return rows


def brute_streaks(rows):
    out, streak = {}, {}
    for host, url, ts, attempt, status, error in sorted(rows, key=lambda r: (r[2], r[1], r[3])):
        failed = error is not None or status in RETRYABLE
        if failed:
            streak[host] = streak.get(host, 0) + 1
        elif status == 200:
            streak[host] = 0
        s = streak.get(host, 0)
        wait = min(1000 * 2 ** min(s, 20), 30000) * (2 if status == 429 else 1) if failed else None
        out[url] = (s, wait)
    return out


@pytest.mark.parametrize("chunk_seconds", [1, 60, 100_000])
def test_streaks_match_an_ordered_walk(spark, chunk_seconds):
    rows = random_rows(1500, seed=3, spread_seconds=600)
    got = fetchlog.host_failure_streak(make_log(spark, rows), chunk_seconds).collect()
    assert {r.url: (r.streak, r.backoff_ms) for r in got} == brute_streaks(rows)
    assert len(got) == len(rows)


def test_host_state_at_a_moment(spark):
    rows = random_rows(800, seed=5, spread_seconds=900)
    as_of = START + timedelta(seconds=500)
    state = {}
    for host, url, ts, attempt, status, error in sorted(rows, key=lambda r: (r[2], r[1])):
        if ts > as_of:
            continue
        fails, last, until = state.get(host, (0, None, None))
        if error is not None or status in RETRYABLE:
            fails += 1
            wait = min(1000 * 2 ** min(fails, 20), 30000) * (2 if status == 429 else 1)
            state[host] = (fails, ts, ts + timedelta(milliseconds=wait))
        elif status == 200:
            state[host] = (0, last, None)
        else:
            state[host] = (fails, last, until)
    log = make_log(spark, rows)
    got = {
        r.host: (r.consecutive_fails, r.last_fail_time, r.backoff_until)
        for r in fetchlog.host_retry_stats(log, as_of).collect()
    }
    assert got == state
    waiting = {h for h, s in state.items() if s[2] is not None and s[2] > as_of}
    assert {r.host for r in fetchlog.hosts_in_backoff(log, as_of).collect()} == waiting


def test_retry_table(spark):
    cases = [(200, None, False), (404, None, False), (429, None, True), (500, None, True),
             (502, None, True), (503, None, True), (504, None, True), (0, "timeout", True)]
    df = spark.createDataFrame([c[:2] for c in cases], "status_code int, error string")
    assert [r[0] for r in df.selectExpr(retry.retryable()).collect()] == [c[2] for c in cases]


def test_retry_defaults():
    assert (retry.MAX_RETRIES, retry.INITIAL_BACKOFF_MS, retry.MAX_BACKOFF_MS) == (3, 1000, 30000)


def test_backoff_bounds(spark):
    df = spark.range(0, 40).selectExpr("cast(id as int) as a", "explode(array(0, 50, 99)) as k")
    rows = df.select(
        "a", "k", F.expr(retry.backoff_ms("a", "503", "k")).alias("w"),
        F.expr(retry.backoff_ms("a", "429", "k")).alias("limited"),
    ).collect()
    for r in rows:
        base = min(1000 * 2**r.a, 30000)
        assert 0.8 * base <= r.w <= 1.2 * base
        assert r.limited == 2 * r.w
        if r.k == 50:
            assert r.w == base


def test_fetch_outcome(spark):
    def attempts(url, *statuses):
        return [("h", url, START, i, s, "reset" if s == 0 else None) for i, s in enumerate(statuses)]

    rows = (
        attempts("a", 503, 503, 200)
        + attempts("b", 503, 503, 503, 503, 200)
        + attempts("c", 404, 200)
        + attempts("d", 0, 0, 0, 0)
        + attempts("e", 200)
        + attempts("f", 0, 500, 404)
    )
    got = {r.url: (r.attempts, r.status_code, r.error, r.success) for r in fetchlog.fetch_outcome(make_log(spark, rows)).collect()}
    assert got == {
        "a": (3, 200, None, True),
        "b": (4, 503, None, False),
        "c": (1, 404, None, False),
        "d": (4, 0, "reset", False),
        "e": (1, 200, None, True),
        "f": (3, 404, None, False),
    }


def test_rows_without_host_or_time_stay(spark):
    rows = random_rows(300, seed=9, spread_seconds=1)
    odd = [(None, "https://n/1", START, 0, 503, None), ("hot.example", "https://n/2", None, 0, 503, None)]
    got = fetchlog.host_failure_streak(make_log(spark, rows + odd)).collect()
    assert {r.url: (r.streak, r.backoff_ms) for r in got} == brute_streaks(rows) | {u: (None, None) for _, u, *_ in odd}
    assert len(got) == 302


def test_many_attempts_are_counted(spark):
    rows = [("h", "a", START, i, 503, None) for i in [*range(70), 3]]
    assert fetchlog.fetch_outcome(make_log(spark, rows), max_retries=69).first().attempts == 70

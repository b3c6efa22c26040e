import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from weblens.operators.chunks import with_chunks
from weblens.operators.sessions import capped_sessions

START = datetime(2024, 1, 1)


def brute(rows, max_age, max_events):
    out, by_user = {}, defaultdict(list)
    for user, event, ts in rows:
        by_user[user].append((ts, event))
    for user, events in by_user.items():
        start, used, number = None, 0, 0
        for ts, event in sorted(events):
            if start is None or (ts - start).total_seconds() > max_age or used >= max_events:
                start, used, number = ts, 0, number + 1
            used += 1
            out[event] = number
    return out


@pytest.mark.parametrize(
    "seed,span,max_age,max_events",
    [(1, 4000, 60, 5), (2, 400, 60, 7), (3, 40_000, 300, 3), (4, 3000, 1800, 100), (5, 30, 1, 2), (6, 600, 60, 1)],
)
def test_matches_an_ordered_walk(spark, seed, span, max_age, max_events):
    rng = random.Random(seed)
    rows = []
    for event in range(1500):
        user = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        # Whole seconds, so ages meet the limit exactly now and then.
        rows.append((user, event, START + timedelta(seconds=rng.randrange(span))))
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    for chunk in (300, 13):
        got = capped_sessions(events, max_age, max_events, chunk).collect()
        assert len(got) == len(rows)
        assert {r.event_id: r.session_no for r in got} == brute(rows, max_age, max_events)


def test_times_before_1970(spark):
    rows = [(1, i, datetime(1969, 12, 31, 23, 59) + timedelta(seconds=7 * i)) for i in range(40)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    got = capped_sessions(events, 30, 100).collect()
    assert {r.event_id: r.session_no for r in got} == brute(rows, 30, 100)


def test_events_without_user_or_time_stay_and_one_second_is_cut(spark):
    rows = [(7, i, START) for i in range(4000)] + [(None, 5000, START), (7, 5001, None)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    got = {r.event_id: r.session_no for r in capped_sessions(events, 60, 7).collect()}
    assert len(got) == len(rows) and got[5000] is None and got[5001] is None
    assert got == brute(rows[:4000], 60, 7) | {5000: None, 5001: None}
    # All rows share one user and one second; partitions this small would be coalesced.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        chunks = with_chunks(events, "user_id", ["ts", "event_id"], 300, "test").groupBy("chunk").count().collect()
        assert {r.event_id: r.session_no for r in capped_sessions(events, 60, 7).collect()} == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in chunks) == 4000 and max(r["count"] for r in chunks) < 1500

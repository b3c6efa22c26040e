"""The bucketed page store: nothing of it is shuffled, replays change nothing."""

from datetime import datetime, timedelta

import pytest

from weblens.schemas import PAGE_RESULT
from weblens.sinks.bucketed import PageStore
from weblens.sinks.exports import sink_results_jsonl
from weblens.sources.results import stream_results
from weblens.streaming import crawl
from weblens.workspace import Workspace

START = datetime(2025, 1, 1)


def page(url, status=200, title="t", hour=0, error=None):
    return (url, 0, status, 5, title, 1, START + timedelta(hours=hour), error)


@pytest.fixture
def store(spark, tmp_path):
    with PageStore(spark, str(tmp_path / "store"), buckets=4) as kept:
        yield kept


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE_RESULT)


def shown(df):
    return {r.url: (r.status_code, r.title) for r in df.collect()}


def exchanges_above_the_store(df):
    """Lines with an exchange on the way from the store's scan to the root of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(n for n, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    depth, found = len(lines[scan]) - len(lines[scan].lstrip(" :+-")), []
    for line in reversed(lines[:scan]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            found += ["Exchange" in line] * ("Exchange" in line)
    return found


def test_newest_row_wins_and_replays_change_nothing(spark, store):
    store.save(frame(spark, page("a"), page("b", 503), page("a", 200, "later", 2)), 1)
    store.save(frame(spark, page("b", 200, "now"), page("c")), 2)
    want = {"a": (200, "later"), "b": (200, "now"), "c": (200, "t")}
    assert shown(store.pages()) == want
    store.save(frame(spark, page("b", 200, "now"), page("c")), 2)
    assert shown(store.pages()) == want and store.log().count() == 4
    assert store.last_batch() == 2


def test_store_side_is_not_shuffled(spark, store):
    store.save(frame(spark, *[page(f"u{i}") for i in range(200)]), 1)
    store.save(frame(spark, *[page(f"u{i}", title="two") for i in range(0, 200, 7)]), 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_above_the_store(store.pages()) == []
        candidates = spark.createDataFrame([(f"u{i}",) for i in range(150, 260)] * 2, "url string")
        fresh = store.new_urls(candidates)
        assert exchanges_above_the_store(fresh) == []
        assert sorted(r.url for r in fresh.collect()) == sorted(f"u{i}" for i in range(200, 260))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reopened_and_compacted(spark, store):
    store.save(frame(spark, page("a"), page("b", 503)), 1)
    store.save(frame(spark, page("b")), 2)
    with PageStore(spark, store.path, buckets=99) as again:
        assert again.buckets == 4 and shown(again.pages()) == {"a": (200, "t"), "b": (200, "t")}
        again.compact()
        assert again.log().count() == 2 and again.last_batch() == 2
    with PageStore(spark, store.path) as third:
        assert shown(third.pages()) == {"a": (200, "t"), "b": (200, "t")}
        third.save(frame(spark, page("c")), 3)
        assert shown(third.pages())["c"] == (200, "t")


def test_empty_store(spark, store):
    assert store.pages().count() == 0 and store.last_batch() == 0
    store.compact()
    assert store.new_urls(spark.createDataFrame([("a",)], "url string")).count() == 1


def test_stream_into_store_survives_a_restart(spark, store):
    space = Workspace(spark, "test-bucketed-stream")
    first = [page("u1", 503, ""), page("u2")]
    second = [page("u1", 200, "now", 1)]
    for rows in (first, second):
        sink_results_jsonl(frame(spark, *rows), space.file("log"))
        crawl.stream_into_store(stream_results(spark, space.file("log")), store, space.file("ck"))
    assert shown(store.pages()) == {"u1": (200, "now"), "u2": (200, "t")}
    crawl.stream_into_store(stream_results(spark, space.file("log")), store, space.file("ck"))
    assert store.log().count() == 3

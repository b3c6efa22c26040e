import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weblens.operators.sessions import capped_sessions
from weblens.schemas import FETCH_LOG, PAGE_RESULT
from weblens.sinks.exports import sink_results_jsonl
from weblens.sinks.store import read_pages
from weblens.sources.results import stream_results
from weblens.streaming import crawl, run
from weblens.streaming.stateful import backoff_step, stream_capped_sessions, stream_host_backoff, stream_progress_totals
from weblens.workspace import Workspace

START = datetime(2024, 1, 1)


def write(df, space, name):
    df.coalesce(1).write.mode("append").parquet(space.file(name))


def stream_of(spark, space, name, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(space.file(name))


def test_backoff_rule():
    assert backoff_step(0, 0, 100, 500, True) == (1, 100 + 2_000_000)
    # Inside a backoff the remaining time stays, doubled for a rate limit.
    assert backoff_step(1, 2_000_100, 1_000_100, 500, True) == (2, 2_000_100)
    assert backoff_step(1, 2_000_100, 1_000_100, 429, True) == (2, 3_000_100)
    assert backoff_step(9, 0, 0, 503, True) == (10, 30_000_000)
    assert backoff_step(3, 50, 60, 404, False) == (3, 50)
    assert backoff_step(3, 50, 60, 200, False) == (0, 0)


CLOSING = START + timedelta(days=4000)  # a row that lets the watermark pass all others


def fetch_rows(rng, n):
    rows = []
    for i in range(n):
        status = rng.choice([200, 404, 429, 500, 0])
        rows.append((rng.choice("ab"), f"u{i}", START + timedelta(milliseconds=700 * i), 0, status, "x" if status == 0 else None))
    return rows


def backoff_of(rows):
    state, want = {}, {}
    for host, url, ts, _, status, error in sorted(rows, key=lambda r: r[2]):
        failed = error is not None or status in (429, 500, 502, 503, 504)
        us = int((ts - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        state[host] = backoff_step(*state.get(host, (0, 0)), us, status, failed)
        want[url] = (state[host][0], state[host][1] or None)
    return want


def shown_backoff(space, stream):
    got = space.read("out", stream).select("url", "fails", F.unix_micros("backoff_until").alias("us")).collect()
    assert len(got) == len({r.url for r in got})
    return {r.url: (r.fails, r.us) for r in got}


def test_backoff_state_lives_across_batches(spark):
    run.use_rocksdb(spark)
    rows = fetch_rows(random.Random(4), 300)
    space = Workspace(spark, "test-backoff")
    stream = None
    for part in (rows[:120], rows[120:], [("-", "end", CLOSING, 0, 200, None)]):
        write(spark.createDataFrame(part, FETCH_LOG), space, "in")
        stream = stream_host_backoff(stream_of(spark, space, "in", FETCH_LOG), "1 second")
        run.append_to_table(stream, space.file("out"), space.file("ck"))
    assert shown_backoff(space, stream) == backoff_of(rows)


def test_backoff_of_shuffled_files_and_late_rows(spark):
    run.use_rocksdb(spark)
    rng = random.Random(5)
    rows = fetch_rows(rng, 240)
    arriving = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(30)))
    space = Workspace(spark, "test-disorder")
    late = ("a", "late", START, 0, 500, None)  # comes when its moment has long been passed
    parts = [arriving[n : n + 40] for n in range(0, 240, 40)]
    for part in [*parts, [late], [("-", "end", CLOSING, 0, 200, None)]]:
        rng.shuffle(part)
        write(spark.createDataFrame(part, FETCH_LOG), space, "in")
    stream = stream_host_backoff(stream_of(spark, space, "in", FETCH_LOG), "31 seconds")
    run.append_to_table(stream, space.file("out"), space.file("ck"))
    assert shown_backoff(space, stream) == backoff_of(rows)


def test_idle_hosts_leave_the_state(spark):
    run.use_rocksdb(spark)
    space = Workspace(spark, "test-idle")
    sizes = []
    for day, hosts in enumerate((range(40), range(3), range(3), range(2))):
        rows = [(f"h{h}", f"u{day}-{h}", START + timedelta(days=10 * day, minutes=h), 0, 500, None) for h in hosts]
        write(spark.createDataFrame(rows, FETCH_LOG), space, "in")
        stream = stream_host_backoff(stream_of(spark, space, "in", FETCH_LOG), "1 minute", forget_after_seconds=12 * 86400)
        query = stream.writeStream.format("parquet").option("checkpointLocation", space.file("ck")).trigger(availableNow=True).start(space.file("out"))
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sizes[2] < sizes[0] / 3  # the hosts of the first day are gone, not only idle
    got = {r.url: r.fails for r in spark.read.parquet(space.file("out")).collect()}
    assert got["u1-0"] == 2 and got["u2-1"] == 3  # hosts that come back in time go on


def test_sessions_stream_equals_batch(spark):
    run.use_rocksdb(spark)
    rng = random.Random(6)
    rows, now = [], START
    for event in range(400):
        now += timedelta(seconds=rng.randrange(40))
        rows.append((rng.choice([0, 0, 1, 2]), event, now))
    schema = "user_id long, event_id long, ts timestamp"
    space = Workspace(spark, "test-sessions")
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(300)))
    for part in (shuffled[:150], shuffled[150:], [(-1, -1, CLOSING)]):
        write(spark.createDataFrame(part, schema), space, "in")
        stream = stream_capped_sessions(stream_of(spark, space, "in", schema), 120, 5, "301 seconds")
        run.append_to_table(stream, space.file("out"), space.file("ck"))
    batch = capped_sessions(spark.createDataFrame(rows, schema), 120, 5)
    want = {r.event_id: r.session_no for r in batch.collect()}
    assert {r.event_id: r.session_no for r in space.read("out", stream).collect()} == want


def test_dedup_with_and_without_watermark(spark):
    run.use_rocksdb(spark)
    schema = "url string, ts timestamp"
    space = Workspace(spark, "test-dedup")
    # State expires once the watermark, 90 minutes behind the newest row, has passed it.
    for hour, urls in ((0, ["a", "a", "b"]), (1, ["b", "c"]), (5, ["d"]), (6, ["a", "d"])):
        rows = [(u, START + timedelta(hours=hour)) for u in urls]
        write(spark.createDataFrame(rows, schema), space, "in")
        source = stream_of(spark, space, "in", schema)
        run.append_to_table(crawl.stream_frontier_dedup(source), space.file("all"), space.file("ck1"))
        run.append_to_table(
            crawl.stream_frontier_dedup(source, watermark="90 minutes"), space.file("recent"), space.file("ck2")
        )
    assert sorted(r.url for r in spark.read.parquet(space.file("all")).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.url for r in spark.read.parquet(space.file("recent")).collect()) == ["a", "a", "b", "c", "d"]


def test_result_log_to_page_store(spark):
    space = Workspace(spark, "test-upsert")
    first = [("u1", 0, 503, 0, "", 0, START, "non-200 status: 503"), ("u2", 0, 200, 5, "t", 1, START, None)]
    second = [("u1", 0, 200, 7, "now", 2, START + timedelta(hours=1), None)]
    for rows in (first, second):
        sink_results_jsonl(spark.createDataFrame(rows, PAGE_RESULT).coalesce(1), space.file("log"))
        stream = stream_results(spark, space.file("log"))
        crawl.stream_upsert_pages(stream, space.file("store"), space.file("ck"))
    rows = {r.url: (r.status_code, r.title) for r in read_pages(spark, space.file("store")).collect()}
    assert rows == {"u1": (200, "now"), "u2": (200, "t")}


def test_progress_totals_cross_days(spark):
    rows = [("h", f"u{i}", START + timedelta(hours=9 * i), 0, [200, 500, 404][i % 3], None) for i in range(12)]
    space = Workspace(spark, "test-progress")
    write(spark.createDataFrame(rows[:5], FETCH_LOG), space, "in")
    write(spark.createDataFrame(rows[5:], FETCH_LOG), space, "in")
    counts = crawl.stream_progress_counts(stream_of(spark, space, "in", FETCH_LOG), "1 hour")
    run.updates_to_table(counts, space.file("out"), space.file("ck"))
    report = crawl.progress_report(run.latest_updates(spark, space.file("out"), ["window_start"]))
    got = [tuple(r)[1:] for r in report.orderBy("window_start").collect()]
    want, n, p, e = [], 0, 0, 0
    for r in rows:
        n, p, e = n + 1, p + (r[4] == 200), e + (r[4] == 500)
        want.append((n, p, e, n - p - e))
    assert got == want


def test_running_totals_live_in_the_stream(spark):
    run.use_rocksdb(spark)
    rng = random.Random(3)
    rows = [("h", f"u{i}", START + timedelta(seconds=2 * i), 0, rng.choice([200, 500, 404]), None) for i in range(90)]
    arriving = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(20)))
    space = Workspace(spark, "test-totals")
    for part in (arriving[:40], arriving[40:], [("-", "end", CLOSING, 0, 200, None)]):
        # every run goes on from the checkpoint of the one before
        write(spark.createDataFrame(part, FETCH_LOG), space, "in")
        totals = stream_progress_totals(stream_of(spark, space, "in", FETCH_LOG), "5 seconds", "30 seconds")
        run.append_to_table(totals, space.file("out"), space.file("ck"))
    want, n, p, e = {}, 0, 0, 0
    for r in rows:
        n, p, e = n + 1, p + (r[4] == 200), e + (r[4] == 500)
        second = int((r[2] - START).total_seconds()) // 5 * 5
        want[START + timedelta(seconds=second)] = (n, p, e, n - p - e)
    got = space.read("out", totals).collect()
    assert len(got) == len(want)
    assert {r.window_start: tuple(r)[1:] for r in got} == want


def test_active_keys_stream_is_close(spark):
    """Sketches of panes against exact counts: exact for few users, within 3 % for many."""
    rng = random.Random(8)
    few = [(rng.randrange(30), START + timedelta(seconds=20 * i)) for i in range(300)]
    many = [(rng.randrange(10**9), START + timedelta(days=1, microseconds=20_000 * i)) for i in range(30_000)]
    schema = "user_id long, ts timestamp"
    space = Workspace(spark, "test-active")
    write(spark.createDataFrame(few + many, schema), space, "in")
    write(spark.createDataFrame([(-1, CLOSING)], schema), space, "in")
    run.append_to_table(
        crawl.stream_active_keys(stream_of(spark, space, "in", schema)), space.file("out"), space.file("ck")
    )
    out = spark.read.parquet(space.file("out")).collect()
    assert len(out) > 100
    for r in out:
        part = few if r.window_start < START + timedelta(hours=12) else many
        inside = {u for u, ts in part if r.window_start <= ts < r.window_start + timedelta(minutes=5)}
        assert abs(r.active - len(inside)) <= (0 if part is few else 0.03 * len(inside))

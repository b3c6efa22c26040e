"""Sessions capped by age and by number of events, and trailing-window activity."""

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weblens.operators.chunks import with_chunks, with_unplaced
from weblens.shipping import ship_package

MAX_AGE_SECONDS = 1800
MAX_EVENTS = 100


def capped_sessions(
    events: DataFrame,
    max_age_seconds: int = MAX_AGE_SECONDS,
    max_events: int = MAX_EVENTS,
    chunk_seconds: int = 300,
) -> DataFrame:
    """Number each user's events by session (``session_no`` from 1).

    A session takes events until one is more than ``max_age_seconds`` after its
    first, or it holds ``max_events``.

    Time is cut into chunks no longer than the maximum age, so inside a chunk,
    once a session has begun there, only the event cap can end one: sessions
    begin at some event b and at every ``max_events`` after it. A chunk is
    therefore described by at most ``max_events`` first and last event times,
    and only these descriptions are walked per user. A hot user's events stay
    spread over their chunks, which are bounded in rows too. An event without
    user or time stays, with a null session.
    """
    ship_package()
    seconds = min(chunk_seconds, max_age_seconds)
    in_chunk = Window.partitionBy("user_id", "chunk").orderBy("ts", "event_id")
    # One exchange serves both uses of ``numbered`` below.
    numbered = (
        with_chunks(events, "user_id", ["ts", "event_id"], seconds, "sessions")
        .repartition("user_id", "chunk")
        .withColumn("n", F.row_number().over(in_chunk) - 1)
        .withColumn("size", F.count("*").over(Window.partitionBy("user_id", "chunk")))
    )
    # Session starts fall on one of a chunk's first events, last starts on one of its last.
    edges = numbered.where(f"n < {max_events} or n >= size - {max_events}")
    summary = edges.groupBy("user_id", "chunk").agg(
        F.max("size").alias("size"),
        F.sort_array(F.collect_list(F.unix_micros("ts"))).alias("us"),
    )
    # One pass over each user's descriptions in time order; no group is held in memory.
    entry = (
        summary.repartition("user_id")
        .sortWithinPartitions("user_id", "chunk")
        .mapInArrow(
            _entry_states(max_age_seconds * 1_000_000, max_events),
            "user_id long, chunk long, first_start long, open_no long",
        )
    )
    later = F.expr(f"if(n < first_start, 0L, 1 + (n - first_start) div {max_events})")
    placed = numbered.join(entry, ["user_id", "chunk"]).select(
        *events.columns, (F.col("open_no") + later).alias("session_no")
    )
    return with_unplaced(placed, events, "user_id")


def _entry_states(max_age_us: int, max_events: int):
    """Walk chunk descriptions in (user, time) order; say where each chunk's first session starts."""

    def walk(batches):
        user, start_us, used, number = None, 0, 0, 0
        for batch in batches:
            lists = batch.column("us")
            times, offsets = lists.flatten().to_pylist(), lists.offsets.to_pylist()
            firsts, numbers = [], []
            for who, size, begin, end in zip(
                batch.column("user_id").to_pylist(),
                batch.column("size").to_pylist(),
                offsets,
                offsets[1:],
            ):
                low, high = begin - offsets[0], end - offsets[0]
                if who != user:
                    user, number, first = who, 0, 0
                else:
                    # Beyond the first events the cap ends the session before its age does.
                    head = min(low + max_events, high)
                    aged = bisect_right(times, start_us + max_age_us, low, head)
                    first = min(aged - low if aged < head else size, max_events - used, size)
                firsts.append(first)
                numbers.append(number)
                if first < size:
                    begun = (size - 1 - first) // max_events
                    last = first + begun * max_events
                    start_us, used = times[high - size + last], size - last
                    number += 1 + begun
                else:
                    used += size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("user_id"),
                    batch.column("chunk"),
                    pa.array(firsts, pa.int64()),
                    pa.array(numbers, pa.int64()),
                ],
                names=["user_id", "chunk", "first_start", "open_no"],
            )

    return walk


def active_keys(
    events: DataFrame, window: str = "5 minutes", slide: str = "1 minute"
) -> DataFrame:
    """Distinct users per trailing window.

    Users are deduplicated inside panes of one ``slide`` first, so a window copies users of
    panes and never events.
    """
    panes = events.select(F.window(F.col("ts").cast("timestamp"), slide).alias("pane"), "user_id").distinct()
    return (
        panes.select(F.window(F.col("pane.start"), window, slide).alias("w"), "user_id")
        .distinct()
        .groupBy("w")
        .agg(F.count("*").alias("active"))
        .select(F.col("w.start").alias("window_start"), "active")
    )

"""The crawl's continuous behaviour as streams."""

from pyspark.sql import DataFrame, Window, functions as F

from weblens.functions.retry import retryable
from weblens.operators.robots import robots_decisions
from weblens.sinks.bucketed import PageStore
from weblens.sinks.store import first_batch, kept_first_batch, save_page_batch
from weblens.streaming.run import each_batch


def stream_frontier_dedup(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each URL once.

    Without a watermark the stream remembers every URL for ever, as a crawl
    run does. With one, state is bounded: a URL may return after that time.
    """
    if watermark is None:
        return stream.dropDuplicates(["url"])
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["url"])


def stream_progress_counts(stream: DataFrame, interval: str = "5 seconds", time_column: str | None = None) -> DataFrame:
    """Attempts, successes and errors per interval; emit in update mode.

    ``time_column`` names one more column, the interval's event time, for operators that follow.
    """
    at = [F.window_time("w").alias(time_column)] if time_column else []
    return (
        stream.groupBy(F.window("ts", interval).alias("w"))
        .agg(
            F.count("*").alias("discovered"),
            F.count_if(F.col("status_code") == 200).alias("processed"),
            F.count_if(F.expr(retryable())).alias("errors"),
        )
        .select(*at, F.col("w.start").alias("window_start"), "discovered", "processed", "errors")
    )


def progress_report(counts: DataFrame) -> DataFrame:
    """Running totals over the intervals.

    Days are summed first, so the running sums inside days are independent and
    only one row per day meets in a single window.
    """
    columns = ["discovered", "processed", "errors"]
    daily = counts.withColumn("day", F.to_date("window_start"))
    before_day = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.groupBy("day").agg(*[F.sum(c).alias(c) for c in columns]).select(
        "day", *[F.coalesce(F.sum(c).over(before_day), F.lit(0)).alias(f"{c}_0") for c in columns]
    )
    in_day = (
        Window.partitionBy("day")
        .orderBy("window_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        daily.select("day", "window_start", *[F.sum(c).over(in_day).alias(c) for c in columns])
        .join(carried, "day")
        .select("window_start", *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in columns])
        .withColumn("pending", F.expr("discovered - processed - errors"))
    )


def stream_upsert_pages(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the page store current: each micro-batch becomes one batch of the store.

    Batch numbers start above those that the store held when the checkpoint was new.
    """
    first = first_batch(stream.sparkSession, path, checkpoint)
    each_batch(stream, lambda frame, batch_id: save_page_batch(frame, path, first + batch_id), checkpoint)


def stream_into_store(stream: DataFrame, store: PageStore, checkpoint: str) -> None:
    """As ``stream_upsert_pages``, into a bucketed store: a micro-batch is shuffled to its buckets and nothing else is."""
    first = kept_first_batch(stream.sparkSession, checkpoint, store.last_batch)
    each_batch(stream, lambda frame, batch_id: store.save(frame, first + batch_id), checkpoint)


def stream_robots_filter(stream: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Robots decisions on a stream of URLs against a table of robots files."""
    return robots_decisions(stream, robots, agent)


def stream_active_keys(
    stream: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes", lg_k: int = 14
) -> DataFrame:
    """Approximate number of users per trailing window, by panes: one sketch a ``slide``.

    An event enters one pane's sketch and is never copied into the windows; a window merges the
    sketches of its panes. The error is that of the sketch, about 0.8 / sqrt(2 ** lg_k) (0.7 % at 14),
    and none while a window's users are few enough for the sketch to list them.
    """
    panes = (
        stream.withWatermark("ts", watermark)
        .groupBy(F.window("ts", slide).alias("pane"))
        .agg(F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("users"))
    )
    return (
        panes.select(F.window_time("pane").alias("at"), "users")
        .groupBy(F.window("at", window, slide).alias("w"))
        .agg(F.hll_sketch_estimate(F.hll_union_agg("users", F.lit(False))).alias("active"))
        .select(F.col("w.start").alias("window_start"), "active")
    )

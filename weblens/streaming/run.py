"""Running streams to completion over what is available, with durable output."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.workspace import Workspace

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(space: Workspace, table: DataFrame, name: str, files_per_trigger: int = 8) -> DataFrame:
    """Write a table to the shared folder and read it back as a stream."""
    table.write.mode("overwrite").parquet(space.file(name))
    return (
        space.spark.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(space.file(name))
    )


def replay_in_disorder(space: Workspace, table: DataFrame, name: str, draw: str, last: dict[str, object], slots: int = 2) -> tuple[DataFrame, str]:
    """A table with a time ``ts`` as a stream whose rows come out of order; and the delay to wait for them.

    The time the rows cover is cut into ``slots``; a row arrives up to half a slot late, by a
    hash of column ``draw``, and the rows of a slot come in any order. Every slot is written when
    the one before is there. A row far in the future with the values ``last`` (a key of its own)
    comes at the end and lets the watermark pass all others.
    """
    low, high = table.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = max((high - low) // slots, 1) if low is not None else 1
    late = F.pmod(F.xxhash64(F.lit("late"), F.col(draw)), F.lit(max(width // 2, 1)))
    arrival = (F.unix_micros("ts") + late - F.lit(low or 0)) / F.lit(width)
    placed = space.table(f"{name}-placed", table.withColumn("slot", F.least(F.floor(arrival), F.lit(slots)).cast("int")))
    for slot in range(slots + 1):
        placed.where((F.col("slot") == slot) | (F.col("ts").isNull() & F.lit(slot == 0))).drop("slot").write.mode("append").parquet(space.file(name))
    delay = width + width // 2 + 1_000_000
    end = F.timestamp_micros(F.lit((high or 0) + 3 * delay)).alias("ts")
    closing = [end if c == "ts" else F.lit(last.get(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    space.spark.range(1).select(*closing).write.mode("append").parquet(space.file(name))
    stream = space.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64).parquet(space.file(name))
    return stream, f"{delay // 1_000_000 + 1} seconds"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk beside the JVM heap; stateful processors require it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append it to a Parquet table, exactly once."""
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
        .awaitTermination()
    )


def each_batch(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, one call of ``handle(frame, batch_id)`` per micro-batch."""
    (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def updates_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the changed rows of every micro-batch in its own ``batch_id=N`` folder."""

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    each_batch(stream, write, checkpoint, mode="update")


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last value per key of an updates table."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in keys and c != "batch_id"]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
        .select(*keys, "row.*")
    )

"""Chunks of a key's ordered rows, bounded in time and in rows."""

from pyspark.sql import DataFrame, functions as F

from weblens.workspace import Workspace

_PART_BITS = 24


def with_chunks(rows: DataFrame, key: str, order: list[str], seconds: int, label: str) -> DataFrame:
    """``rows`` with a ``chunk`` number that rises with ``order`` inside each key.

    A chunk spans at most ``seconds`` of ``ts`` and lies in one range partition of
    (key, order), so a key with any number of rows per second is cut into chunks
    no larger than a partition. The chunks are written once: range bounds are
    drawn by sampling, and every use must see the same ones. Rows without key or
    time have no place in the order and are left out.
    """
    width = seconds * 1_000_000
    slot = f"(unix_micros(ts) - pmod(unix_micros(ts), {width})) div {width}"
    placed = rows.where(f"{key} is not null and ts is not null").repartitionByRange(key, *order)
    chunk = F.expr(f"shiftleft({slot}, {_PART_BITS}) + spark_partition_id()")
    return Workspace(rows.sparkSession, label).table("chunks", placed.withColumn("chunk", chunk))


def with_unplaced(annotated: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``annotated`` and the rows without key or time, whose added columns are null."""
    added = [f for f in annotated.schema.fields if f.name not in rows.columns]
    unplaced = rows.where(f"{key} is null or ts is null").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in added}
    )
    return annotated.unionByName(unplaced.select(*annotated.columns))

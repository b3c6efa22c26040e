"""What the operators of this folder share: tables, draws and batches."""

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblens.shipping import ship_package
from weblens.workspace import Workspace

#: Words are runs of characters other than these (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch: texts are long, and a batch is held by Spark and by Python.
BATCH_ROWS = 500


def workspace(spark: SparkSession, label: str) -> Workspace:
    """A fresh folder under ``spark.checkpoint.dir``; Python code travels with the job.

    Arrow batches are kept small for the session, which bounds memory and changes no result.
    """
    ship_package()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return Workspace(spark, label)


def released(run):
    """A task's function that gives its memory back to the system at its end.

    Python workers live on for the stages that follow, and without this each keeps the most
    that any of them held: tables in reference cycles, Arrow's pools, the heap's free lists.
    """

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return held


def uniform(*keys: Column, seed: str) -> Column:
    """A repeatable draw in (0, 1) from 52 bits of an md5 of the keys and the seed."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        if sizes <= limit or batch.num_rows == 1:
            if batch.num_rows:
                yield batch
            continue
        start, held = 0, 0
        for row, value in enumerate(batch.column(column)):
            size = 0 if not value.is_valid else value.as_buffer().size
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Join small batches until about ``limit`` bytes are held."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def text_key(text: str = "text") -> Column:
    """xxhash64 of a text; a null one counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def as_row(docs: DataFrame, *keys: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside key columns, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text_key) is not in the written table ``rejected``.

    ``rejected`` comes from a table of known size, so a short list is broadcast
    by the optimizer and a long one is joined by shuffle.
    """
    rows = as_row(docs, F.col("doc_id").alias("id"), text_key().alias("key"))
    r = rejected.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key")).distinct()
    return rows.join(r, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left_anti").select("row.*")


#: 64-bit words of a bitmap at most: 8 MB sent to each executor.
MARKED_WORDS = 1 << 20


def marks(keys: DataFrame) -> DataFrame:
    """One row whose array ``marks`` is a bitmap over the hashes of the rows of ``keys``, for ``parted``.

    16 bits a key or more while they fit; beyond, more rows are marked without need and none is missed.
    """
    words = min(MARKED_WORDS, 1 << (keys.count() // 4).bit_length())
    at = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(64 * words)).alias("at"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(bits.alias("bits")).toArrow()
    bitmap = np.zeros(words, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.createDataFrame(pa.table({"marks": pa.array([bitmap], pa.list_(pa.int64()))}))


def parted(rows: DataFrame, keys: list[str], marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``keys`` may be among those of ``marked`` (columns of the same types), and those whose are not.

    The test is made where a row is read, so a join by shuffle need only move the first part.
    """
    bitmap = marked["marks"]
    at = F.pmod(F.xxhash64(*keys), F.size(bitmap) * 64)
    held = F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1
    return rows.join(F.broadcast(marked), held, "left_semi"), rows.join(F.broadcast(marked), held, "left_anti")

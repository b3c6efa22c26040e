"""Writers of the store tables.

The page store is a log of batches, ``batch_seq=N`` folders. A batch is
reduced to one row per URL and overwrites its own folder, so a replayed batch
changes nothing and a write never rewrites the store. Readers take the newest
row per URL; ``compact_pages`` folds the log into one batch.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.operators.store import latest_page
from weblens.plans.extraction import links_table, meta_tags_table, structured_data_table
from weblens.schemas import PAGE_RESULT, PAGE_RESULT_COLUMNS


def save_page_batch(results: DataFrame, path: str, batch_seq: int) -> None:
    """Store one batch of results under ``batch_seq``, last row per URL."""
    rows = results.select(*PAGE_RESULT_COLUMNS, F.lit(batch_seq).cast("bigint").alias("batch_seq"))
    (
        latest_page(rows)
        .drop("batch_seq")
        .write.mode("overwrite")
        .parquet(f"{path}/batch_seq={batch_seq}")
    )


def first_batch(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The batch number at which the stream of ``checkpoint`` starts in the store.

    Batch 0 belongs to compaction.
    """

    def last() -> int:
        try:
            return read_page_log(spark, path).agg(F.max("batch_seq")).first()[0] or 0
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    return kept_first_batch(spark, checkpoint, last)


def kept_first_batch(spark: SparkSession, checkpoint: str, last_batch: Callable[[], int]) -> int:
    """The number of a stream's first batch, chosen once and kept beside its checkpoint.

    It lies above every batch that is there: a restart finds its own batches again, a fresh
    checkpoint never meets older ones.
    """
    kept = f"{checkpoint}-first-batch"
    try:
        return spark.read.schema("first bigint").parquet(kept).first()[0]
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
    number = last_batch() + 1
    spark.range(1).select(F.lit(number).cast("bigint").alias("first")).write.parquet(kept)
    return number


def read_page_log(spark: SparkSession, path: str) -> DataFrame:
    schema = PAGE_RESULT.simpleString()[len("struct<") : -1].replace(":", " ")
    return spark.read.schema(f"{schema}, batch_seq bigint").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Current page table: newest stored row per URL."""
    return latest_page(read_page_log(spark, path))


def compact_pages(spark: SparkSession, path: str, target: str) -> None:
    """Write the current page table as the single first batch of a new store."""
    current = read_pages(spark, path).drop("batch_seq")
    current.write.mode("overwrite").parquet(f"{target}/batch_seq=0")


def save_links(pages: DataFrame, path: str) -> None:
    links_table(pages).write.mode("append").parquet(path)


def save_meta_tags(pages: DataFrame, path: str) -> None:
    meta_tags_table(pages).write.mode("append").parquet(path)


def save_structured_data(pages: DataFrame, path: str) -> None:
    structured_data_table(pages).write.mode("append").parquet(path)

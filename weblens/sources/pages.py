"""Reader for tables of page bodies."""

from pyspark.sql import DataFrame, SparkSession


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Page table for extraction, read as it lies.

    ``partitions`` spreads a table of few row groups over that many tasks, at
    the cost of a shuffle of the bodies.
    """
    pages = spark.read.parquet(path)
    return pages if partitions is None else pages.repartition(partitions)

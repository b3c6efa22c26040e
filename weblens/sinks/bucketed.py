"""A page store whose URLs are placed once: buckets by hash of the URL, one folder a batch.

The store is an external table partitioned by ``batch_seq`` and bucketed by ``url``. The number of
buckets is fixed when it is created. A batch is shuffled to its buckets once, when it is written;
after that neither the newest row per URL nor a probe of the seen set moves a row of the store.
A batch overwrites its own partition, so a replayed batch changes nothing and nothing else is
rewritten; ``compact`` folds all batches into one.
"""

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.operators.store import latest_page
from weblens.schemas import PAGE_RESULT, PAGE_RESULT_COLUMNS

BUCKETS = 256


class PageStore:
    """The store at ``path``; made if it is not there, opened with its own number of buckets if it is.

    The catalog's entry belongs to this object: ``close`` removes it, the files stay.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._created_with(buckets)
        self.table = f"weblens_store_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAGE_RESULT.fields)
        spark.sql(
            f"""CREATE TABLE {self.table} ({columns}, batch_seq BIGINT) USING parquet
            PARTITIONED BY (batch_seq) CLUSTERED BY (url) INTO {self.buckets} BUCKETS LOCATION :path""",
            args={"path": f"{self.path}/batches"},
        )
        if self._holds_batches():
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _holds_batches(self) -> bool:
        try:
            self.spark.read.schema(PAGE_RESULT).parquet(f"{self.path}/batches")
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _created_with(self, buckets: int) -> int:
        kept = f"{self.path}/buckets"
        try:
            return self.spark.read.schema("buckets int").parquet(kept).first()[0]
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.parquet(kept)
        return buckets

    def __enter__(self) -> "PageStore":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def log(self) -> DataFrame:
        """Every stored row, with its ``batch_seq``."""
        return self.spark.table(self.table)

    def last_batch(self) -> int:
        """The highest batch number there is, 0 for an empty store; read from the partitions' names."""
        names = [r[0] for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]
        return max((int(re.fullmatch(r"batch_seq=(\d+)", n)[1]) for n in names), default=0)

    def save(self, results: DataFrame, batch_seq: int) -> None:
        """Store one batch, last row per URL; a repeated call replaces it."""
        rows = latest_page(results.select(*PAGE_RESULT_COLUMNS, F.lit(batch_seq).cast("bigint").alias("batch_seq")))
        # One file a bucket, whatever the number of tasks.
        placed = rows.select(*PAGE_RESULT_COLUMNS).repartition(self.buckets, "url")
        results.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch_seq = {int(batch_seq)}) SELECT * FROM {{rows}}", rows=placed
        )

    def pages(self) -> DataFrame:
        """Newest row per URL; every bucket is aggregated where it lies."""
        return latest_page(self.log())

    def new_urls(self, candidates: DataFrame) -> DataFrame:
        """Distinct candidate URLs that the store does not hold; only the candidates are shuffled."""
        placed = candidates.select("url").repartition(self.buckets, "url").distinct()
        return placed.join(self.log().select("url"), "url", "left_anti")

    def compact(self) -> None:
        """Fold all batches into the last one."""
        last = self.last_batch()
        if not last:
            return
        held = f"{self.path}/compacting-{uuid.uuid4().hex}"
        self.pages().select(*PAGE_RESULT_COLUMNS).write.parquet(held)
        current = self.spark.read.schema(PAGE_RESULT).parquet(held)
        self.save(current, last)
        for (name,) in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect():
            number = int(name.split("=")[1])
            if number < last:
                # Dropping a partition of an external table leaves its files, so it is emptied first.
                none = self.spark.createDataFrame([], PAGE_RESULT)
                self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch_seq = {number}) SELECT * FROM {{none}}", none=none)
                self.spark.sql(f"ALTER TABLE {self.table} DROP PARTITION (batch_seq = {number})")

"""The shared folder for intermediate tables, stream checkpoints and state.

Iterative jobs and streams keep their intermediate data here, never in an
executor's local storage, so a lost executor costs a re-read and nothing more.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it, an execution's shuffle files go at its end; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is an error, because its nodes share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weblens-"))
    return context.getCheckpointDir().rstrip("/")


class Workspace:
    """A fresh sub-folder of the shared folder for one run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/weblens/{label}-{uuid.uuid4().hex}"

    def file(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as a Parquet table and read it back.

        Cuts the lineage, computes the rows once, and gives the optimizer real
        file sizes to choose join strategies from. The shuffle files of the
        write are removed at its end, so a job of many tables never holds all of theirs.
        """
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.file(name))
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.file(name))

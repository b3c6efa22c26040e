"""Seen-set probes, exact: no URL is wrongly held to be seen."""

from pyspark.sql import DataFrame, functions as F


def mark_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates with ``maybe_seen``: whether the URL is in ``seen``; false for a null URL.

    Seen URLs are reduced before the shuffle, and every candidate row stays, repeats included.
    """
    known = seen.select(F.col("url").alias("_seen")).where("_seen is not null").distinct()
    marked = candidates.join(known, F.col("url") == F.col("_seen"), "left")
    return marked.select(*candidates.columns, F.col("_seen").isNotNull().alias("maybe_seen"))

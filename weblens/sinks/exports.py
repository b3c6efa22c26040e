"""Exports of crawl results: JSON lines, CSV and XML sitemaps.

Every export is a folder of part files, one per task.
"""

from pyspark.sql import DataFrame, Observation, functions as F

from weblens.functions.core import rfc3339
from weblens.schemas import PAGE_RESULT_COLUMNS

_URLSET = 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def sink_results_jsonl(results: DataFrame, path: str) -> None:
    """Append results to a log; a NULL ``error`` is left out of its line."""
    results.select(*PAGE_RESULT_COLUMNS).write.mode("append").json(path)


def export_json(results: DataFrame, path: str) -> None:
    """All results as JSON lines (not one pretty-printed array, which no task could write alone)."""
    results.select(*PAGE_RESULT_COLUMNS).write.mode("overwrite").json(path)


def csv_rows(results: DataFrame) -> DataFrame:
    return results.select(
        F.col("url").alias("URL"),
        F.col("status_code").alias("StatusCode"),
        F.col("content_length").alias("ContentLength"),
        F.col("link_count").alias("LinkCount"),
        F.expr(rfc3339("crawled_at")).alias("CrawledAt"),
    )


def export_csv(results: DataFrame, path: str) -> None:
    """Five columns with a header line per part file; quotes are doubled as RFC 4180 asks."""
    csv_rows(results).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sitemap_rows(
    results: DataFrame,
    lastmod: bool = True,
    changefreq: bool = True,
    priority: float = 0.5,
) -> DataFrame:
    """SITEMAP_URL rows of the status-200 results; NULL elements are not written."""
    return results.where("status_code = 200").select(
        F.col("url").alias("loc"),
        (F.expr(rfc3339("crawled_at")) if lastmod else F.lit(None).cast("string")).alias("lastmod"),
        F.lit("weekly" if changefreq else None).cast("string").alias("changefreq"),
        F.lit(priority if priority else None).cast("double").alias("priority"),
    )


def sitemap_preset_rows(results: DataFrame) -> DataFrame:
    """The fixed sitemap: priority 0.8, last modification and weekly change frequency on."""
    return sitemap_rows(results, priority=0.8)


def export_sitemap(rows: DataFrame, path: str) -> int:
    """Write SITEMAP_URL rows as XML and return how many there were, counted while writing."""
    counter = Observation()
    (
        rows.observe(counter, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .format("xml")
        .option("rootTag", _URLSET)
        .option("rowTag", "url")
        .save(path)
    )
    return counter.get["n"]

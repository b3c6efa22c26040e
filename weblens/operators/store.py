"""Queries on crawl results and on the four store tables."""

from pyspark.sql import Column, DataFrame, functions as F

from weblens.schemas import PAGE_RESULT_COLUMNS

# How the error text of each failing stage begins.
ERROR_CLASSES = [
    "invalid URL",
    "persona creation failed",
    "blocked by robots.txt",
    "request failed",
    "nil response",
    "non-200 status",
    "body read failed",
    "panic during processing",
]


def query_pages(pages: DataFrame, **filters) -> DataFrame:
    """Pages with the given ``status_code`` and ``depth``; other filter names are ignored."""
    out = pages
    for name in ("status_code", "depth"):
        if name in filters:
            out = out.where(F.col(name) == filters[name])
    return out.select(*PAGE_RESULT_COLUMNS)


def pages_404(pages: DataFrame) -> DataFrame:
    return pages.where("status_code = 404").select("url")


def pages_200_limit(pages: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` successful pages by URL."""
    return pages.where("status_code = 200").orderBy("url").limit(n)


def pages_with_meta(meta_tags: DataFrame, name: str = "og:type", content: str = "article"):
    """URLs carrying one exact meta tag."""
    return meta_tags.where((F.col("name") == name) & (F.col("content") == content)).select("url")


def most_linked_pages(links: DataFrame, n: int = 10) -> DataFrame:
    """Targets with most incoming links. Counts are combined before the shuffle."""
    return (
        links.groupBy("target_url")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "target_url")
        .limit(n)
    )


def store_stats(pages: DataFrame) -> DataFrame:
    """Total, successful and failed pages in one scan."""
    return pages.agg(
        F.count("*").alias("total_pages"),
        F.count_if(F.col("status_code") == 200).alias("successful_pages"),
        F.count_if(
            F.coalesce(F.col("status_code") != 200, F.lit(False)) | F.col("error").isNotNull()
        ).alias("failed_pages"),
    )


def crawl_summary(results: DataFrame, discovered: DataFrame) -> DataFrame:
    """Run counters. ``discovered`` has one row (column ``url``) per discovery, repeats included.

    The success rate keeps the run report's formula: errors are not part of
    ``processed``, so the rate can be negative.
    """
    counts = results.agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    found = (
        discovered.groupBy("url")
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("discovered"),
            F.count("*").alias("discovered_unique"),
        )
    )
    # Two one-row tables, joined on a constant key.
    key = F.lit(1).alias("k")
    return (
        found.select("*", key)
        .join(counts.select("*", key), "k")
        .select(
            "discovered",
            "discovered_unique",
            "processed",
            "errors",
            F.when(
                F.col("processed") > 0,
                (F.col("processed") - F.col("errors")).cast("double") / F.col("processed") * 100,
            ).alias("success_rate"),
        )
    )


def error_class(error: Column) -> Column:
    """Stage that failed; NULL for no error, ``other`` for an unknown text."""
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name in ERROR_CLASSES:
        out = out.when(error.startswith(name), F.lit(name))
    return out.otherwise(F.lit("other"))


def error_summary(results: DataFrame) -> DataFrame:
    return (
        results.where(F.col("error").isNotNull())
        .groupBy(error_class(F.col("error")).alias("error_class"))
        .agg(F.count("*").alias("count"))
    )


def request_error_detail(results: DataFrame) -> DataFrame:
    """Error text split into class, detail after the colon, and the status code it names."""
    error = F.col("error")
    return results.where(error.isNotNull()).select(
        "url",
        error_class(error).alias("error_class"),
        F.regexp_extract(error, "(?s)^[^:]*: ?(.*)$", 1).alias("detail"),
        F.regexp_extract(error, "^non-200 status: ([0-9]+)$", 1)
        .try_cast("int")
        .alias("error_status"),
    )


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose target was crawled with a status other than 200.

    Only failed pages enter the join; adaptive execution broadcasts them when
    they are small and splits hot targets when they are not.
    """
    failed = pages.where("status_code <> 200").select(
        F.col("url").alias("target_url"), "status_code"
    )
    return links.join(failed, "target_url").select("source_url", "target_url", "status_code")


def page_profile(pages: DataFrame, meta_tags: DataFrame, structured_data: DataFrame) -> DataFrame:
    """One row per page with its meta map and distinct JSON-LD blocks.

    The detail tables are reduced per (url, name) and grouped by page before
    the join, so no page row is multiplied and repeats never pile up.
    """
    meta = (
        meta_tags.groupBy("url", "name")
        .agg(F.max("content").alias("content"))
        .groupBy("url")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("meta_tags"))
    )
    blocks = structured_data.groupBy("url").agg(
        F.array_sort(F.collect_set("json_data")).alias("json_data")
    )
    return pages.join(meta, "url", "left").join(blocks, "url", "left")


def latest_page(results: DataFrame) -> DataFrame:
    """Newest row per URL: highest batch, then latest crawl time.

    ``max_by`` is combined before the shuffle, so a URL crawled a million times
    sends one row per task.
    """
    order = F.struct("batch_seq", "crawled_at", "status_code", "title")
    rest = [c for c in results.columns if c != "url"]
    return (
        results.groupBy("url")
        .agg(F.max_by(F.struct(*rest), order).alias("row"))
        .select("url", "row.*")
    )


def upsert_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-replace by URL: the row with the higher ``batch_seq`` stays."""
    return latest_page(existing.unionByName(new))

"""The crawl's page pipeline as one batch job."""

from pyspark.sql import DataFrame, functions as F

from weblens.functions import html as H
from weblens.functions.core import each, keep
from weblens.functions.retry import MAX_RETRIES
from weblens.functions.urls import url_host
from weblens.operators.fetchlog import fetch_outcome
from weblens.operators.frontier import in_scope
from weblens.operators.navigation import follow_link_sample, visible_links, weighted_links
from weblens.operators.robots import robots_decisions
from weblens.plans.extraction import with_clean

_QUEUED = ("url", "depth", "crawled_at")


def _plain(pages: DataFrame) -> DataFrame:
    return with_clean(pages).selectExpr(
        *_QUEUED,
        "cast(octet_length(html) as bigint) as content_length",
        f"{H.title('cleaned')} as title",
        f"{H.page_links('tags', 'url')} as links",
    )


def _weighted(pages: DataFrame, bias: float | None, seed: int, allow_external: bool) -> DataFrame:
    """Visible links, sampled by weight if a bias is given, within scope. No title is read."""
    sized = pages.withColumn("content_length", F.octet_length("html").cast("long"))
    found = visible_links(weighted_links(sized, (*_QUEUED[1:], "content_length")))
    if bias is not None:
        found = follow_link_sample(found, bias, seed)
    links = keep(each("links", lambda l: f"{l}.url"), lambda l: in_scope(l, "host", allow_external))
    return found.withColumn("host", F.expr(url_host("url"))).selectExpr(
        *_QUEUED, "content_length", "'' as title", f"{links} as links"
    )


def crawled_pages(
    pages: DataFrame,
    attempts: DataFrame,
    robots: DataFrame,
    agent: str,
    max_retries: int = MAX_RETRIES,
    weighted: bool = False,
    bias: float | None = None,
    seed: int = 0,
    allow_external: bool = False,
) -> DataFrame:
    """PAGE_RESULT rows with the array of the page's ``links``.

    ``pages`` brings url, html, depth and crawled_at, with ``weighted`` also
    page_id. The error is that of the first failing stage. A body is parsed where
    it is read, so the joins move a page's title and links and never its HTML.
    """
    parsed = _weighted(pages, bias, seed, allow_external) if weighted else _plain(pages)
    outcomes = fetch_outcome(attempts, max_retries).select(
        "url", F.col("status_code").alias("answer"), F.col("error").alias("failure")
    )
    return (
        robots_decisions(parsed, robots, agent)
        .join(outcomes, "url", "left")
        .withColumn(
            "error",
            F.expr(
                """case when not allowed then 'blocked by robots.txt'
                when failure is not null then concat('request failed: ', failure)
                when answer is null then 'nil response'
                when answer <> 200 then concat('non-200 status: ', answer) end"""
            ),
        )
        .selectExpr(
            "url",
            "depth",
            "if(allowed and failure is null, coalesce(answer, 0), 0) as status_code",
            "if(error is null, content_length, 0L) as content_length",
            "if(error is null, title, '') as title",
            "if(error is null, cast(size(links) as int), 0) as link_count",
            "crawled_at",
            "error",
            "if(error is null, links, array()) as links",
        )
    )


def page_results(pages: DataFrame, attempts: DataFrame, robots: DataFrame, agent: str, **options) -> DataFrame:
    """PAGE_RESULT rows: robots check, fetch outcome, then title and links of fetched pages.

    The options are those of ``crawled_pages``.
    """
    return crawled_pages(pages, attempts, robots, agent, **options).drop("links")


def page_edges(crawled: DataFrame, allow_external: bool = False) -> DataFrame:
    """(url, depth, parent_url): what the pages of ``crawled_pages`` add to the frontier."""
    links = keep("links", lambda l: in_scope(l, "host", allow_external))
    return crawled.withColumn("host", F.expr(url_host("url"))).select(
        F.explode(F.expr(links)).alias("link"), F.col("depth") + 1, "url"
    ).toDF("url", "depth", "parent_url")

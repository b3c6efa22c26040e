"""Sitemap discovery over tables of fetched sitemap and robots files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.functions.core import each, let, lit
from weblens.functions.html import unescape
from weblens.functions.urls import trim_space, url_origin
from weblens.plans.graph import breadth_first
from weblens.workspace import Workspace

# Where sites keep their sitemaps.
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """Every ``<loc>`` outside comments, decoded, then trimmed, in document order, repeats included."""
    text = f"regexp_replace(body, {lit(r'(?s)<!--.*?(?:-->|\z)')}, '')"
    found = f"regexp_extract_all({text}, {lit(r'(?is)<loc(?:\s[^>]*)?>(.*?)</loc\s*>')}, 1)"
    decoded = each(found, lambda t: let(unescape(t), trim_space))
    return sitemaps.selectExpr("sitemap_url", f"posexplode({decoded}) as (pos, loc)")


def sitemap_candidates(start_urls: DataFrame) -> DataFrame:
    """The well-known sitemap URLs of each start URL."""
    paths = ", ".join(lit(p) for p in WELL_KNOWN)
    return start_urls.selectExpr(
        "url", f"{url_origin('url')} as origin", f"explode(array({paths})) as path"
    ).selectExpr("url", "concat(origin, path) as sitemap_url")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap lines of robots files. Only the value is trimmed: an indented line does not count."""
    return (
        robots.selectExpr("robots_url", "posexplode(split(body, '\\n')) as (pos, line)")
        .where("startswith(lower(line), 'sitemap:')")
        .selectExpr("robots_url", "pos", f"{trim_space('substr(line, 9)')} as sitemap_url")
    )


def sitemap_index_expand(spark: SparkSession, roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Leaf URLs (``loc``) reachable from ``roots`` (``sitemap_url``), once per naming sitemap.

    A loc that ends in ``.xml`` or contains ``sitemap`` is a nested sitemap.
    Each sitemap is visited once; a missing or failed one contributes nothing.
    Bodies are parsed once; the traversal runs on the nested references alone.
    """
    nested = F.col("loc").endswith(".xml") | F.col("loc").contains("sitemap")
    space = Workspace(spark, "sitemaps")
    locs = space.table("locs", sitemap_locs(sitemaps.where("status = 200")))
    references = locs.where(nested).select(
        F.col("sitemap_url").alias("source_url"), F.col("loc").alias("target_url")
    )
    reached = breadth_first(
        spark, roots.select(F.col("sitemap_url").alias("url")), references
    ).select(F.col("url").alias("sitemap_url"))
    leaves = locs.where(~nested)
    return leaves.join(reached, "sitemap_url", "left_semi").select("sitemap_url", "pos", "loc")


def seed_sitemap(
    spark: SparkSession, start_url: str, robots: DataFrame, sitemaps: DataFrame
) -> DataFrame:
    """Seeds of one site: well-known sitemaps and those its robots file names, expanded."""
    start = spark.range(1).select(F.lit(start_url).alias("url"))
    own_robots = robots.where(
        F.col("robots_url") == F.expr(f"concat({url_origin(lit(start_url))}, '/robots.txt')")
    )
    roots = (
        sitemap_candidates(start)
        .select("sitemap_url")
        .unionByName(robots_sitemaps(own_robots).select("sitemap_url"))
    )
    return sitemap_index_expand(spark, roots, sitemaps).select(F.col("loc").alias("url"))

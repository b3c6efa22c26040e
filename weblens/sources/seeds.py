"""Seed discovery from certificate and crawl-index dumps, and their union."""

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.functions.core import lit
from weblens.functions.urls import domain_no_port, strip_wildcard, url_scheme
from weblens.sources.json_arrays import read_json_arrays


def read_certificates(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """Certificate dump with ``name_value``.

    A dump is one JSON array per file; many tasks read one file. With ``array_file=False`` the
    records stand one per line.
    """
    if array_file:
        return read_json_arrays(spark, path, "name_value string")
    return spark.read.schema("name_value string").json(path)


def seed_ct(records: DataFrame, start_url: str, strict_domain: bool = False) -> DataFrame:
    """Distinct subdomain URLs of the start URL's domain named by certificate records.

    Names count when they end with the domain, label boundary or not;
    ``strict_domain`` keeps the domain and true subdomains only.
    """
    start = records.sparkSession.range(1).selectExpr(
        f"{domain_no_port(lit(start_url))} as domain", f"{url_scheme(lit(start_url))} as scheme"
    ).first()
    name = F.col("name")
    wanted = name.endswith(start.domain)
    if strict_domain:
        wanted = (name == start.domain) | name.endswith(f".{start.domain}")
    return (
        records.selectExpr("explode(split(name_value, '\\n')) as raw")
        .selectExpr(f"{strip_wildcard('raw')} as name")
        .where(wanted)
        .distinct()
        .select(F.concat(F.lit(f"{start.scheme}://"), name).alias("url"))
    )


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """Crawl-index dump, one JSON object per line; malformed lines are dropped."""
    return spark.read.schema("url string").option("mode", "DROPMALFORMED").json(path)


def seed_crawl_index(
    index: DataFrame, domain: str | None = None, max_records: int | None = None
) -> DataFrame:
    """Distinct non-empty URLs of an index dump, of one domain if given.

    ``max_records`` reads only that many records, first by URL, as the index
    service would return them.
    """
    records = index
    if domain is not None:
        host = F.expr(domain_no_port("url"))
        records = records.where((host == domain) | host.endswith(f".{domain}"))
    if max_records is not None:
        records = records.orderBy("url").limit(max_records)
    return records.where("url <> ''").select("url").distinct()


# Strategy names in their running order.
STRATEGIES = ["sitemap", "ct", "crawl_index"]
SYNONYMS = {"commoncrawl": "crawl_index"}


def seed_union(strategy: str, seeds: dict[str, DataFrame]) -> DataFrame:
    """(url, strategy, depth) seeds of the chosen strategies, each URL under the first that names it.

    ``strategy`` is ``none``, ``all`` or a comma-separated list; strategies without a
    result are skipped, unknown names too, with a warning. ``commoncrawl`` is another name of
    ``crawl_index``.
    """
    given = [SYNONYMS.get(n.strip(), n.strip()) for n in strategy.split(",") if n.strip()]
    if unknown := set(given) - {*STRATEGIES, "all", "none"}:
        warnings.warn(f"unknown seed strategies: {', '.join(sorted(unknown))}", stacklevel=2)
    names = STRATEGIES if strategy == "all" else given
    chosen = [(rank, n) for rank, n in enumerate(names) if n in seeds]
    if not chosen or strategy == "none":
        any_frame = next(iter(seeds.values()))
        return any_frame.sparkSession.createDataFrame([], "url string, strategy string, depth int")
    parts = [seeds[n].select("url", F.lit(rank).alias("rank")) for rank, n in chosen]
    union = reduce(DataFrame.unionByName, parts)
    names_by_rank = F.array(*[F.lit(n) for n in names])
    return (
        union.groupBy("url")
        .agg(F.min("rank").alias("rank"))
        .select("url", names_by_rank[F.col("rank")].alias("strategy"), F.lit(0).alias("depth"))
    )


def seed_counts(seeds: DataFrame) -> DataFrame:
    """Seeds added per strategy."""
    return seeds.groupBy("strategy").agg(F.count("*").alias("added"))

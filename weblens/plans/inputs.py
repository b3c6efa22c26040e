"""Crawl-shaped inputs derived from the given tables.

The given tables hold pages and events, but no fetch logs, robots files,
sitemaps or seed dumps. Each function here derives one of those from them, row
for row, so that every input grows with the tables. The rules are the ones in
``FIXTURES.md``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.functions.urls import url_host, url_origin

SEED_SITE = "https://seed.example.com"

_HEAD = """concat(
    '<meta name="description" content="d', page_id, '">',
    if(page_id % 2 = 1, concat('<meta name="description" content="second ', page_id, '">'), ''),
    '<meta name="keywords" content="k', page_id % 7, ', crawl">',
    '<meta property="og:type" content="', if(page_id % 3 = 0, 'article', 'website'), '">',
    '<link rel="canonical" href="/c/', page_id, '">',
    '<link rel="stylesheet" href="/s.css">',
    '<script src="/a.js"></script>',
    if(page_id % 4 = 0,
       concat('<script type="application/ld+json">{"@id": ', page_id, '}</script>'), ''),
    '</head>')"""

_FOOTER = """
    <a href="mailto:x@example.com">mail</a><a href="#top">top</a>
    <a href="https://other.example.net/x?utm_source=f">Other</a>
    <a href="?b=2&amp;a=1&amp;gclid=z">Products</a><a href="../up">Up</a>
    <a href="/hidden" style="display:none">Hidden</a>
    <a class="btn" href="/buy"><img src="/i.png"></a>
    <a class="is-hidden" href="/about">About us</a></footer>"""

_ROBOTS = """case
    when h in ('0', '1') then 'User-agent: *\\nDisallow:\\n'
    when h in ('2', '3', '4') then 'User-agent: *\\nDisallow: /en/\\n'
    when h in ('5', '6') then 'User-agent: *\\nDisallow: /\\nAllow: /es/ # spanish\\n'
    when h in ('7', '8', '9') then 'User-agent: *\\nDisallow: /*/1*0$\\nDisallow: /en/2\\n'
    when h in ('a', 'b') then
        'User-agent: otherbot\\nUser-agent: LensBot\\nDisallow: /fr/\\n\\nUser-agent: *\\nDisallow: /\\n'
    when h in ('c', 'd') then concat(
        'User-agent: *\\nDisallow: /de/\\nSitemap: https://seed.example.com/sitemap-3.xml\\n',
        'SITEMAP:https://seed.example.com/sitemap-4.xml\\n sitemap: https://seed.example.com/no.xml\\n')
    when h = 'e' then 'User-agent: *\\nDisallow: /\\n'
    else '<html>Internal Server Error</html>' end"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def enriched_pages(pages: DataFrame) -> DataFrame:
    """Pages with metadata, assets and footer links."""
    return pages.select(
        "page_id",
        "url",
        F.replace(
            F.replace("html", F.lit("</head>"), F.expr(_HEAD)), F.lit("</footer>"), F.lit(_FOOTER)
        ).alias("html"),
    )


def with_shells(pages: DataFrame) -> DataFrame:
    """``pages`` and, for every tenth, one more row with the body of a JavaScript shell."""
    shells = pages.where("page_id % 10 = 0").select(
        (-1 - F.col("page_id")).alias("page_id"), "url", F.lit('<div id="root"></div>').alias("html")
    )
    return pages.union(shells)


def crawl_results(pages: DataFrame) -> DataFrame:
    """One PAGE_RESULT row per page, with every kind of outcome, plus ``batch_seq`` 1."""
    return pages.selectExpr(
        "url",
        "cast(page_id % 5 as int) as depth",
        """cast(case page_id % 10 when 0 then 404 when 1 then 503 when 2 then 0
           else 200 end as int) as status_code""",
        "cast(octet_length(html) as bigint) as content_length",
        "concat('Page ', page_id) as title",
        "cast(page_id % 7 as int) as link_count",
        "timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id) as crawled_at",
        """case when page_id % 10 = 0 then 'non-200 status: 404'
            when page_id % 10 = 1 then 'non-200 status: 503'
            when page_id % 20 = 2 then concat('request failed: Get "', url, '": no such host')
            when page_id % 10 = 2 then 'blocked by robots.txt' end as error""",
        "cast(1 as bigint) as batch_seq",
    )


def second_batch(pages: DataFrame) -> DataFrame:
    """A later crawl of every seventh page, all successful."""
    return pages.where("page_id % 7 = 0").selectExpr(
        "url",
        "cast(page_id % 5 as int) as depth",
        "200 as status_code",
        "cast(octet_length(html) + 1 as bigint) as content_length",
        "concat('Page ', page_id, ' again') as title",
        "cast(page_id % 7 as int) as link_count",
        "timestamp'2025-02-01 00:00:00' + make_dt_interval(0, 0, 0, page_id) as crawled_at",
        "cast(null as string) as error",
        "cast(2 as bigint) as batch_seq",
    )


def fetch_log(events: DataFrame) -> DataFrame:
    """One fetch attempt per event."""
    return (
        events.withColumn("host", F.expr("concat('h', user_id % 20, '.example.org')"))
        .selectExpr(
            "host",
            "concat('https://', host, '/', event_id % 500) as url",
            "cast(ts as timestamp) as ts",
            "cast(event_id div 500 % 4 as int) as attempt",
            """cast(case when event_type = 'error' and event_id % 5 = 0 then 0
               when event_type = 'error' and event_id % 3 = 0 then 429
               when event_type = 'error' then 500
               when event_type = 'signup' then 404 else 200 end as int) as status_code""",
            """case when event_type = 'error' and event_id % 5 = 0
               then 'connection reset by peer' end as error""",
        )
    )


def page_attempts(pages: DataFrame) -> DataFrame:
    """Fetch attempts per page: 503 until the last, which ends the page's fetch."""
    return (
        pages.selectExpr(
            "page_id", "url", "explode(sequence(0, cast(page_id % 5 as int))) as attempt"
        )
        .selectExpr(
            f"{url_host('url')} as host",
            "url",
            """timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 10 + attempt)
               as ts""",
            "attempt",
            """cast(case when attempt < page_id % 5 then 503 when page_id % 7 = 0 then 404
               when page_id % 11 = 0 then 503 else 200 end as int) as status_code""",
            "cast(null as string) as error",
        )
    )


def link_graph(pages: DataFrame) -> DataFrame:
    """Two edges per page: page i points to pages (3i+1) and (5i+2) modulo the page count."""
    n = pages.count()
    targets = pages.select(F.col("page_id").alias("target_id"), F.col("url").alias("target_url"))
    return (
        pages.selectExpr(
            "url as source_url",
            f"explode(array((3 * page_id + 1) % {n}, (5 * page_id + 2) % {n})) as target_id",
        )
        .join(targets, "target_id")
        .select("source_url", "target_url")
    )


def graph_seeds(pages: DataFrame) -> DataFrame:
    return pages.where("page_id = 0").select("url")


def robots_files(pages: DataFrame) -> DataFrame:
    """One robots file per origin, plus the one of the seed site."""
    per_origin = (
        pages.selectExpr(f"{url_origin('url')} as origin", f"{url_host('url')} as host")
        .distinct()
        .withColumn("h", F.expr("substr(md5(host), 1, 1)"))
        .selectExpr(
            "concat(origin, '/robots.txt') as robots_url",
            "case h when 'e' then 404 when 'f' then 500 else 200 end as status",
            f"{_ROBOTS} as body",
        )
    )
    seed_site = pages.where("page_id = 0").selectExpr(
        f"'{SEED_SITE}/robots.txt' as robots_url",
        "200 as status",
        f"'Sitemap: {SEED_SITE}/sitemap-9.xml\\nsitemap:{SEED_SITE}/sitemap.xml\\n' as body",
    )
    return per_origin.unionByName(seed_site)


def sitemap_files(pages: DataFrame) -> DataFrame:
    """One sitemap per page, forming a tree of fan-out eight with a link back to the parent."""
    nested = f"""concat_ws('', transform(sequence(1, 8), k -> concat(
        '<sitemap><loc>{SEED_SITE}/sitemap-', page_id * 8 + k, '.xml</loc></sitemap>')))"""
    return pages.selectExpr(
        f"""if(page_id = 0, '{SEED_SITE}/sitemap.xml',
            concat('{SEED_SITE}/sitemap-', page_id, '.xml')) as sitemap_url""",
        "if(page_id % 13 = 5, 500, 200) as status",
        f"""concat('<?xml version="1.0"?><urlset>', {nested},
            '<sitemap><loc>{SEED_SITE}/sitemap-', (page_id - 1) div 8, '.xml</loc></sitemap>',
            '<url><loc> ', replace(url, '&', '&amp;'), '\\n</loc></url>',
            '<url><loc>{SEED_SITE}/about</loc></url></urlset>') as body""",
    )


def certificate_names(pages: DataFrame) -> DataFrame:
    """Certificate records, several names each: plain, wildcard, mail, look-alike and foreign."""
    return (
        pages.selectExpr(f"{url_host('url')} as host")
        .distinct()
        .selectExpr(
            """concat(host, '\\n*.', host, '\\n admin@', host, ' \\ntest', host,
               '\\n', host, '.evil.test') as name_value"""
        )
    )


def index_lines(pages: DataFrame) -> DataFrame:
    """Crawl-index lines: repeats, empty URLs and cut-off JSON among them."""
    return pages.selectExpr(
        """explode(array(
            to_json(named_struct('url', url, 'status', '200')),
            to_json(named_struct('url', url)),
            if(page_id % 50 = 7, '{"url": "http://cut.example.com/', '{"url": ""}')
        )) as value"""
    )

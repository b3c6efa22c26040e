"""Page extraction: one row per page in, links, metadata and assets out."""

from pyspark.sql import DataFrame, functions as F

from weblens.functions import html as H


def with_clean(pages: DataFrame) -> DataFrame:
    """Adds ``cleaned``, the HTML without comments and raw text, and ``tags`` found in it."""
    return pages.withColumn("cleaned", F.expr(H.clean("html"))).withColumn(
        "tags", F.expr(H.tags("cleaned"))
    )


def extract_structured(pages: DataFrame) -> DataFrame:
    """Everything parsed out of a page, as one struct column ``data``."""
    return with_clean(pages).selectExpr(
        "page_id",
        "url",
        f"""named_struct(
            'links', {H.anchor_links("tags", "url")},
            'title', {H.title("cleaned")},
            'meta_tags', {H.meta_map("tags")},
            'images', {H.images("tags", "url")},
            'scripts', {H.scripts("tags", "url")},
            'stylesheets', {H.stylesheets("tags", "url")},
            'json_data', {H.jsonld("html")}) as data""",
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """Title and distinct links per page."""
    return with_clean(pages).selectExpr(
        "page_id",
        "url",
        f"{H.title('cleaned')} as title",
        f"{H.page_links('tags', 'url')} as links",
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per distinct link of a page, with its position among them."""
    return (
        with_clean(pages)
        .selectExpr(
            "page_id", "url", f"posexplode({H.page_links('tags', 'url')}) as (pos, link)"
        )
    )


def links_table(pages: DataFrame) -> DataFrame:
    """LINKS rows: every resolvable anchor with its text, repeats included."""
    return (
        with_clean(pages)
        .selectExpr(
            "url as source_url", f"posexplode({H.anchors('cleaned', 'url')}) as (pos, anchor)"
        )
        .selectExpr(
            "source_url",
            "anchor.url as target_url",
            "anchor.anchor_text as anchor_text",
            "pos",
        )
    )


def link_targets(pages: DataFrame) -> DataFrame:
    """(source_url, target_url) of every resolvable anchor; skips the anchor texts."""
    hrefs = H.normalize_urls(H.anchor_hrefs("tags"), "url")
    return with_clean(pages).selectExpr("url as source_url", f"explode({hrefs}) as target_url")


def meta_tags_table(pages: DataFrame) -> DataFrame:
    """META_TAGS rows: one per page and meta name, last content wins."""
    return with_clean(pages).selectExpr(
        "url", f"explode({H.meta_map('tags')}) as (name, content)"
    )


def structured_data_table(pages: DataFrame) -> DataFrame:
    """STRUCTURED_DATA rows: one per JSON-LD block."""
    return pages.selectExpr("url", f"explode({H.jsonld('html')}) as json_data")


def asset_counts(pages: DataFrame) -> DataFrame:
    """Description, keywords and asset counts: the page columns no crawl writes by itself."""
    return (
        with_clean(pages)
        .selectExpr(
            "url",
            f"{H.meta_map('tags')} as meta",
            f"cast(size({H.images('tags', 'url')}) as int) as image_count",
            f"cast(size({H.scripts('tags', 'url')}) as int) as script_count",
        )
        .selectExpr(
            "url",
            "meta['description'] as meta_description",
            "meta['keywords'] as meta_keywords",
            "image_count",
            "script_count",
        )
    )

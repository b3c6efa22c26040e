"""Fixed schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

PAGE_RESULT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("link_count", T.IntegerType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)

PAGES = T.StructType(
    PAGE_RESULT.fields
    + [
        T.StructField("meta_description", T.StringType()),
        T.StructField("meta_keywords", T.StringType()),
        T.StructField("image_count", T.IntegerType()),
        T.StructField("script_count", T.IntegerType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("source_url", T.StringType()),
        T.StructField("target_url", T.StringType()),
        T.StructField("anchor_text", T.StringType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

META_TAGS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

STRUCTURED_DATA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("json_data", T.StringType()),
    ]
)

STORE_TABLES = {
    "pages": PAGES,
    "links": LINKS,
    "meta_tags": META_TAGS,
    "structured_data": STRUCTURED_DATA,
}

SITEMAP_URL = T.StructType(
    [
        T.StructField("loc", T.StringType()),
        T.StructField("lastmod", T.StringType()),
        T.StructField("changefreq", T.StringType()),
        T.StructField("priority", T.DoubleType()),
    ]
)

FETCH_LOG = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

PAGE_RESULT_COLUMNS = PAGE_RESULT.fieldNames()

"""Readers for result logs and store tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from weblens.functions import html as H
from weblens.schemas import PAGE_RESULT, STORE_TABLES


def scan_results_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Result log: one JSON object per line; blank and malformed lines are dropped.

    Missing numbers read as 0 and a missing title as empty, as the log's writer
    leaves them out. The zero timestamp (year 1) reads as NULL. A path that
    does not exist is an empty log.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAGE_RESULT)
    return _parsed(raw)


def _parsed(lines: DataFrame) -> DataFrame:
    """Rows of the lines that parse as a whole, whatever columns a plan goes on to read."""
    fields = PAGE_RESULT.simpleString()[len("struct<") : -1].replace(":", " ")
    options = "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_bad')"
    parsed = lines.where("trim(value) <> ''").selectExpr(f"from_json(value, '{fields}, _bad string', {options}) as r")
    return _with_zero_values(parsed.where("r is not null and r._bad is null").select("r.*"))


def _with_zero_values(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "coalesce(url, '') as url",
        "coalesce(depth, 0) as depth",
        "coalesce(status_code, 0) as status_code",
        "coalesce(content_length, 0) as content_length",
        "coalesce(title, '') as title",
        "coalesce(link_count, 0) as link_count",
        "if(year(crawled_at) <= 1, null, crawled_at) as crawled_at",
        "error",
    )


def stream_results(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The result log as a stream: a folder that gains files, each read once."""
    return _parsed(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def scan_store_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four store tables, also registered as temporary views of the same names."""
    tables = {}
    for name, schema in STORE_TABLES.items():
        tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        tables[name].createOrReplaceTempView(name)
    return tables


def scan_html_pages(pages: DataFrame) -> DataFrame:
    """Page bodies with their length in bytes."""
    return pages.selectExpr(
        "page_id", "url", "html", "cast(octet_length(html) as bigint) as content_length"
    )


def needs_js_render(pages: DataFrame) -> DataFrame:
    return pages.selectExpr("page_id", "url", f"{H.needs_js_render('html')} as needs_js_render")

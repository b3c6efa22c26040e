import csv
import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weblens.operators import store
from weblens.schemas import PAGE_RESULT
from weblens.sinks import exports, store as store_sink
from weblens.sources.results import scan_results_jsonl, scan_store_tables

ROW = ("https://example.com/?a=1&b=2", 1, 200, 1024, 'T "q"', 5, datetime(2025, 1, 1, 12), None)
OTHER = ("https://example.com/2", 0, 200, 2048, "", 3, datetime(2025, 1, 1, 13), None)
FAILED = ("https://example.com/3", 2, 404, 0, "", 0, datetime(2025, 1, 1, 14), "non-200 status: 404")


@pytest.fixture
def results(spark):
    return spark.createDataFrame([ROW, OTHER, FAILED], PAGE_RESULT)


def test_log_reader(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text(
        '{"url":"https://example.com","depth":0,"status_code":200,"content_length":513,"title":"Example Domain",'
        '"link_count":1,"crawled_at":"2025-11-10T13:28:22.108317-05:00"}\n'
        "\n{broken\n"
        '{"url":"https://m.example.com","crawled_at":"0001-01-01T00:00:00Z","error":"panic during processing: x"}'
    )
    rows = {r.url: r for r in scan_results_jsonl(spark, str(log)).collect()}
    assert len(rows) == 2
    good, bad = rows["https://example.com"], rows["https://m.example.com"]
    assert good.error is None and good.title == "Example Domain"
    stamp = scan_results_jsonl(spark, str(log)).where("depth = 0 and link_count = 1")
    assert stamp.selectExpr("unix_micros(crawled_at)").first()[0] == 1762799302108317
    assert (bad.status_code, bad.title, bad.crawled_at) == (0, "", None)


def test_missing_log_is_empty(spark, tmp_path):
    assert scan_results_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_log_round_trip_appends_and_omits_null_error(spark, results, tmp_path):
    path = str(tmp_path / "log")
    exports.sink_results_jsonl(results, path)
    exports.sink_results_jsonl(results, path)
    assert scan_results_jsonl(spark, path).count() == 6
    lines = [json.loads(x) for f in glob.glob(f"{path}/part-*") for x in open(f)]
    assert all(("error" in x) == (x["status_code"] != 200) for x in lines)


def test_json_export(results, tmp_path):
    path = str(tmp_path / "json")
    exports.export_json(results, path)
    exports.export_json(results, path)
    lines = [json.loads(x) for f in glob.glob(f"{path}/part-*") for x in open(f)]
    assert sorted(x["content_length"] for x in lines) == [0, 1024, 2048]


def test_csv_export(results, tmp_path):
    path = str(tmp_path / "csv")
    exports.export_csv(results.coalesce(1), path)
    (part,) = glob.glob(f"{path}/part-*")
    rows = list(csv.reader(open(part)))
    assert rows[0] == ["URL", "StatusCode", "ContentLength", "LinkCount", "CrawledAt"]
    assert sorted(rows[1:]) == [
        ["https://example.com/2", "200", "2048", "3", "2025-01-01T13:00:00Z"],
        ["https://example.com/3", "404", "0", "0", "2025-01-01T14:00:00Z"],
        ["https://example.com/?a=1&b=2", "200", "1024", "5", "2025-01-01T12:00:00Z"],
    ]


def test_sitemap_export(results, tmp_path):
    path = str(tmp_path / "sitemap")
    assert exports.export_sitemap(exports.sitemap_preset_rows(results).coalesce(1), path) == 2
    (part,) = [f for f in glob.glob(f"{path}/part-*") if not f.endswith(".crc")]
    text = open(part).read()
    assert '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' in text
    assert "<loc>https://example.com/?a=1&amp;b=2</loc>" in text
    assert "<priority>0.8</priority>" in text and "<changefreq>weekly</changefreq>" in text
    assert "<lastmod>2025-01-01T12:00:00Z</lastmod>" in text and "example.com/3" not in text


def test_sitemap_options(results, tmp_path):
    plain = exports.sitemap_rows(results, lastmod=False, changefreq=False, priority=0)
    path = str(tmp_path / "plain")
    exports.export_sitemap(plain.coalesce(1), path)
    (part,) = [f for f in glob.glob(f"{path}/part-*") if not f.endswith(".crc")]
    assert not any(t in open(part).read() for t in ("lastmod", "changefreq", "priority"))
    assert exports.sitemap_rows(results).first().priority == 0.5
    assert exports.export_sitemap(exports.sitemap_rows(results.where("false")), str(tmp_path / "e")) == 0


def test_page_store_batches(spark, results, tmp_path):
    path = str(tmp_path / "store")
    store_sink.save_page_batch(results, path, 1)
    newer = results.where("depth = 2").withColumn("status_code", F.lit(200)).withColumn("error", F.lit(None).cast("string"))
    # Within a batch the later row of a URL wins; a replayed batch changes nothing.
    twice = newer.unionByName(newer.withColumn("crawled_at", F.expr("crawled_at + interval 1 hour")).withColumn("title", F.lit("last")))
    for _ in range(2):
        store_sink.save_page_batch(twice, path, 2)
    rows = {r.url: r for r in store_sink.read_pages(spark, path).collect()}
    assert len(rows) == 3 and rows[FAILED[0]].title == "last" and rows[FAILED[0]].status_code == 200
    target = str(tmp_path / "compact")
    store_sink.compact_pages(spark, path, target)
    assert {r.url: r.title for r in store_sink.read_pages(spark, target).collect()} == {u: r.title for u, r in rows.items()}


def test_store_views(spark, results, tmp_path):
    pages = spark.createDataFrame(
        [("https://example.com/", '<meta name=a content=1><a href="/x">t</a><script type="application/ld+json">{}</script>')],
        "url string, html string",
    )
    base = str(tmp_path)
    store_sink.save_links(pages, f"{base}/links")
    store_sink.save_meta_tags(pages, f"{base}/meta_tags")
    store_sink.save_structured_data(pages, f"{base}/structured_data")
    results.write.parquet(f"{base}/pages")
    tables = scan_store_tables(spark, base)
    assert [tuple(r) for r in tables["links"].collect()] == [("https://example.com/", "https://example.com/x", "t", 0)]
    assert spark.sql("SELECT name, content FROM meta_tags").first() == ("a", "1")
    assert spark.sql("SELECT json_data FROM structured_data").first()[0] == "{}"
    assert spark.sql("SELECT count(meta_description) FROM pages").first()[0] == 0


def test_stats_and_filters(results):
    assert tuple(store.store_stats(results).first()) == (3, 2, 1)
    assert store.query_pages(results).count() == 3
    assert [r.url for r in store.query_pages(results, status_code=404, depth=2).collect()] == [FAILED[0]]
    assert store.query_pages(results, status_code=404, depth=0).count() == 0
    assert [tuple(r) for r in store.error_summary(results).collect()] == [("non-200 status", 1)]
    detail = store.request_error_detail(results).first()
    assert (detail.error_class, detail.detail, detail.error_status) == ("non-200 status", "404", 404)


def test_summary_of_an_empty_crawl(results):
    empty = results.where("false")
    row = store.crawl_summary(empty, empty.select("url")).first()
    assert (row.discovered, row.discovered_unique, row.processed, row.errors, row.success_rate) == (0, 0, 0, 0, None)
    row = store.crawl_summary(results, results.select("url").unionByName(results.select("url"))).first()
    assert (row.discovered, row.discovered_unique, row.processed, row.errors, row.success_rate) == (6, 3, 2, 1, 50.0)


def test_profile_survives_repeated_saves(spark, results):
    meta = spark.createDataFrame([(OTHER[0], "k", "1"), (OTHER[0], "k", "2"), (OTHER[0], "j", "3")], "url string, name string, content string")
    blocks = spark.createDataFrame([(OTHER[0], "{}"), (OTHER[0], "{}")], "url string, json_data string")
    rows = {r.url: r for r in store.page_profile(results, meta, blocks).collect()}
    assert rows[OTHER[0]].meta_tags == {"k": "2", "j": "3"} and rows[OTHER[0]].json_data == ["{}"]
    assert rows[ROW[0]].meta_tags is None and len(rows) == 3

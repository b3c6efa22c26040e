"""Hostile or unusual inputs: very many attributes, robots quoting, bad log lines, fresh checkpoints."""

import pytest
from pyspark.sql import functions as F

from weblens.functions import html as H
from weblens.operators import robots
from weblens.schemas import PAGE_RESULT
from weblens.sinks import store
from weblens.sources import results, seeds


def test_very_many_attributes(spark):
    tag = "<a " + " ".join(f"a{i}=1" for i in range(100_000)) + ' href="/x">'
    row = spark.createDataFrame([(tag,)], "t string").select(F.expr(H.attribute("t", "href"))).first()
    assert row[0] == "/x"


@pytest.mark.parametrize(
    "tag, name, value",
    [
        ("<a HREF = '/a&amp;b' href=x>", "href", "/a&b"),
        ("<a hrefs=1 data-href=2>", "href", None),
        ("<a href>", "href", ""),
        ("<img/src=i.png/>", "src", "i.png/"),
        ('<a title="href=no" href="y">', "href", "y"),
    ],
)
def test_attribute_values(spark, tag, name, value):
    assert spark.createDataFrame([(tag,)], "t string").select(F.expr(H.attribute("t", name))).first()[0] == value


def test_robots_patterns_hold_any_text(spark):
    body = "User-agent: *\nDisallow: /*\\E(\nDisallow: /a[b*c$\nDisallow: /p+*\n"
    files = spark.createDataFrame([("https://h/robots.txt", 200, body)], "robots_url string, status int, body string")
    urls = [("https://h/x\\E(",), ("https://h/a[b--c",), ("https://h/aab--c",), ("https://h/p+q",), ("https://h/ppq",)]
    out = robots.robots_decisions(spark.createDataFrame(urls, "url string"), files, "bot")
    assert {r.url[10:]: r.allowed for r in out.collect() if "\\" not in r.url} == {"a[b--c": False, "aab--c": True, "p+q": False, "ppq": True}


def test_log_rows_do_not_depend_on_columns(spark, tmp_path):
    lines = ['{"url":"https://a/","depth":1}', '{"url":"https://b/","depth":"bad"}', "", "no json", '{"depth":3}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = results.scan_results_jsonl(spark, str(tmp_path))
    assert log.count() == len(log.collect()) == len(log.select("url").collect()) == 2
    assert {r.url for r in log.collect()} == {"https://a/", ""}


def test_fresh_checkpoint_keeps_the_store(spark, tmp_path):
    path, stored = str(tmp_path / "store"), [(f"https://{i}/", 0, 200, 1, "", 0, None, None) for i in range(5)]
    names = [f.name for f in PAGE_RESULT]
    frame = spark.createDataFrame(stored, "url string, depth int, status_code int, content_length long, title string, link_count int, crawled_at timestamp, error string")
    frame = frame.select(*[F.col(n).cast(PAGE_RESULT[n].dataType) for n in names])
    one = store.first_batch(spark, path, str(tmp_path / "one"))
    store.save_page_batch(frame, path, one)
    two = store.first_batch(spark, path, str(tmp_path / "two"))
    assert one == 1 and two == 2 and store.first_batch(spark, path, str(tmp_path / "one")) == 1
    store.save_page_batch(frame.limit(1).withColumn("url", F.lit("https://new/")), path, two)
    assert store.read_pages(spark, path).count() == 6


def test_unknown_strategy_is_not_silent(spark):
    frame = spark.createDataFrame([("https://a/",)], "url string")
    with pytest.warns(UserWarning, match="unknown"):
        assert seeds.seed_union("sitemap,unknown", {"sitemap": frame}).count() == 1
    assert seeds.seed_union("commoncrawl", {"crawl_index": frame}).first().strategy == "crawl_index"

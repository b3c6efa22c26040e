import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weblens.functions import dom
from weblens.operators import navigation as nav

PAGE = """<html><body class="site"><nav><a href="/home">Home</a></nav>
<main><p>x<p><a href="/deep">A long enough text</a>
<a href="/none" style="display:none">No</a><a class="BTN" href="/buy"><img src=i.png></a>
<a class="is-hidden" href="/h">Hidden</a><a href="/empty"> </a><a href="">skip</a></main>
<div id="Footer-1"><ul><li><a href="/about">About &amp; us</a><li><a href="mailto:x@y.z">Mail</a></ul></div></body></html>"""


@pytest.fixture(scope="module")
def weighted(spark):
    pages = spark.createDataFrame(
        [(1, "https://example.com/x/", PAGE), (2, "https://example.com/", "")],
        "page_id long, url string, html string",
    )
    return nav.weighted_links(pages).cache()


def links(df):
    return {r.page_id: r.links for r in df.collect()}


def test_positions_and_weights(weighted):
    rows = {l.href: l for l in links(weighted)[1]}
    assert list(rows) == ["/home", "/deep", "/none", "/buy", "/h", "/empty", "/about", "mailto:x@y.z"]
    assert rows["/home"].position.in_nav and rows["/home"].in_navigation
    assert rows["/home"].position.depth == 3
    assert rows["/home"].weight == 1.0
    assert rows["/deep"].position.in_main and rows["/deep"].position.depth == 4
    assert rows["/deep"].weight == pytest.approx(1.0)
    assert rows["/about"].position.in_footer and rows["/about"].anchor_text == "About & us"
    assert rows["/about"].position.depth == 5
    assert rows["/about"].weight == pytest.approx(0.5 - 0.3 + 0.2 + 0.1 + 0.15)
    assert rows["/buy"].weight == pytest.approx(1.0)
    assert rows["/about"].url == "https://example.com/about"
    assert rows["mailto:x@y.z"].url is None
    assert {h: l.is_visible for h, l in rows.items()} == {
        "/home": True, "/deep": True, "/none": False, "/buy": True, "/h": False,
        "/empty": False, "/about": True, "mailto:x@y.z": True,
    }


def test_empty_page_has_no_links(weighted):
    assert links(weighted)[2] == []
    row = nav.link_stats(weighted).where("page_id = 2").first()
    assert (row.total_links, row.avg_weight, row.max_weight, row.min_weight) == (0, 0.0, 0.0, 1.0)


def test_visible_filter(spark):
    df = spark.createDataFrame(
        [(1, [(0.9, True), (0.5, False), (0.8, True), (0.1, True)])],
        "page_id long, links array<struct<weight double, is_visible boolean>>",
    )
    assert [l.weight for l in nav.visible_links(df).first().links] == [0.9, 0.8]


def test_top_links_keeps_page_order_on_ties(spark):
    df = spark.createDataFrame(
        [(1, [(0, 0.5), (1, 0.9), (2, 0.5), (3, 0.9)]), (2, [(0, 0.1), (1, 0.2)])],
        "page_id long, links array<struct<pos int, weight double>>",
    )
    got = links(nav.top_links(df, 3))
    assert [l.pos for l in got[1]] == [1, 3, 0]
    assert [l.pos for l in got[2]] == [0, 1]


def test_select_weighted_link(spark):
    many = [(i, [(0, 0.0), (1, 0.2), (2, 0.8)]) for i in range(2000)]
    df = spark.createDataFrame(many, "page_id long, links array<struct<pos int, weight double>>")
    picks = [r.pos for r in nav.select_weighted_link(df, bias=1.0).collect()]
    assert len(picks) == 2000 and picks.count(0) == 0
    assert 0.75 < picks.count(2) / 2000 < 0.85
    again = [r.pos for r in nav.select_weighted_link(df, bias=1.0).collect()]
    assert picks == again
    zero = spark.createDataFrame(
        [(1, [(0, 0.0), (1, 0.0)]), (2, [])], "page_id long, links array<struct<pos int, weight double>>"
    )
    assert [(r.page_id, r.pos) for r in nav.select_weighted_link(zero, 0.5).collect()] == [(1, 0)]
    with pytest.raises(ValueError):
        nav.bias_pow("w", 0)


def test_selectors(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")

    def texts(s):
        return [r.text for r in nav.extract_by_selector(pages, s).orderBy("pos").collect()]

    assert texts("nav a") == ["Home"]
    assert texts("#Footer-1 li") == ["About & us", "Mail"]
    assert texts("a[href='/deep'], a.BTN") == ["A long enough text", ""]
    assert texts("body.site main a[style]") == ["No"]
    for bad in ("a >", "a:last-child", "a::before", ""):
        with pytest.raises(ValueError):
            nav.extract_by_selector(pages, bad)


def depths(page):
    return [len(n.ancestors) for n in dom.select(page, lambda n, _: n.tag == "a")]


def test_open_formatting_is_carried_on():
    # html, body and the elements written out, plus every <b> still open, three at most.
    assert depths("<p><b>x<p><a href=1>y</a>") == [4]
    assert depths("<article><p><b>x<p><b>y</article><footer>t <a href=1>y</a></footer>") == [5]
    assert depths("<div>" + "<p><b>x" * 6 + "</div><a href=1>y</a>") == [5]
    assert depths("<p><b>x</b><p><a href=1>y</a>") == [3]
    assert depths("<b><p>x</b><a href=1>y</a>") == [3]
    assert depths("<b><table><tr><td><i>x</td><td><a href=1>y</a></td></table>") == [6]
    # An unclosed link is carried on as well; another link ends it.
    assert depths("<p><a href=1>x<p>y<a href=2>z</a>") == [3, 3, 3]


def test_raw_text_and_comments_hold_no_elements():
    page = "<!-- <a href=/c>c</a> --><script>'<a href=/s>'</script><title><a href=/t></title><noscript><a href=/n></noscript><a href=/y>y"
    found = dom.select(page, lambda n, _: n.tag == "a")
    assert [n.attributes["href"] for n in found] == ["/y"]


def test_deep_pages_take_linear_time():
    start = time.monotonic()
    found = dom.select("<nav>" + "<div><a href=/x>t</a>" * 20_000 + "</i>" * 20_000, lambda n, _: n.tag == "a")
    assert len(found) == 20_000 and found[-1].around.depth == 20_003
    assert nav._marks_around(found[-1].around) == (True, False, False)
    assert time.monotonic() - start < 10


def test_failed_page_is_no_page_without_links(spark, monkeypatch, weighted):
    def fails(page):
        raise ValueError(page)

    monkeypatch.setattr(nav, "_page_facts", fails)
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "html": ["x"]})
    out = list(nav._scan([batch]))[0].to_pylist()
    assert out == [{"page_id": 1, "facts": None, "error": "ValueError: x"}]
    broken = weighted.limit(1).withColumn("links", F.when(F.col("page_id") < 0, F.col("links")))
    stats = nav.link_stats(broken).drop("page_id").first()
    assert set(stats) == {None}
    assert nav.top_links(broken, 2).first().links is None
    assert nav.select_weighted_link(broken, 1.0).count() == 0

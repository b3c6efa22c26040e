import html as pyhtml

from pyspark.sql import functions as F

from weblens.functions.core import lit
from weblens.functions import html as H

BASE = "https://example.com/dir/page"


def run(spark, text, *exprs):
    df = spark.createDataFrame([(text,)], "html string").withColumn("c", F.expr(H.clean("html"))).withColumn("t", F.expr(H.tags("c")))
    return df.select(*[F.expr(e("html", "c", "t")).alias(f"c{i}") for i, e in enumerate(exprs)]).first()


PAGE = """<!DOCTYPE html><HTML><head><title lang=en>A &amp; B &#8364;&#x41;&copy</title><title>second</title>
<meta name="description" content="first"><meta content='last &quot;x&quot;' name=description>
<meta property="og:type" content="article"><meta name=k content><meta name=nocontent>
<link rel="canonical" href="/canon"><link rel=alternate href='/alt'><link rel="stylesheet" href="s.css">
<link rel="stylesheet preload" href="no.css">
<script src="/a.js"></script><script type="application/ld+json">{"a": "</b>"}</script>
<script>var x = '<a href="/fake">';</script><!-- <a href="/comment">x</a> --></head>
<body data-href="/no"><noscript><a href="/noscript">n</a></noscript>
<a title="x > href=y" href="one?b=1&amp;a=2">One <b>bold</b></a>
<a href=two>Two</a><a HREF='/dir/two'>again</a><a>none</a><a href="#x">frag</a><a href>empty</a>
<img src="/i.png"><img src="/i.png"><img alt=x></body></HTML>"""


def test_everything(spark):
    b = lit(BASE)
    row = run(
        spark,
        PAGE,
        lambda h, c, t: H.title(c),
        lambda h, c, t: H.page_links(t, b),
        lambda h, c, t: H.anchor_links(t, b),
        lambda h, c, t: H.images(t, b),
        lambda h, c, t: H.scripts(t, b),
        lambda h, c, t: H.stylesheets(t, b),
        lambda h, c, t: H.meta_map(t),
        lambda h, c, t: H.jsonld(h),
        lambda h, c, t: H.anchors(c, b),
    )
    assert row.c0 == "A & B €A©"
    anchors = ["https://example.com/dir/one?a=2&b=1", "https://example.com/dir/two"]
    assert row.c1 == anchors + ["https://example.com/canon", "https://example.com/alt"]
    assert row.c2 == anchors
    assert row.c3 == ["https://example.com/i.png"] * 2
    assert row.c4 == ["https://example.com/a.js"]
    assert row.c5 == ["https://example.com/dir/s.css"]
    assert row.c6 == {"description": 'last "x"', "og:type": "article", "k": ""}
    assert row.c7 == ['{"a": "</b>"}']
    assert [tuple(a) for a in row.c8] == [
        (anchors[0], "One bold"),
        (anchors[1], "Two"),
        (anchors[1], "again"),
    ]


def test_empty_page(spark):
    b = lit(BASE)
    row = run(spark, "", lambda h, c, t: H.title(c), lambda h, c, t: H.page_links(t, b), lambda h, c, t: H.meta_map(t))
    assert row.c0 == "" and row.c1 == [] and row.c2 == {}


def test_title_and_links(spark):
    page = (
        "<html><head><title>Test Page</title></head><body>"
        '<a href="https://example.com/page1">1</a><a href="/page2">2</a><a href="page3">3</a></body></html>'
    )
    b = lit("https://example.com")
    row = run(spark, page, lambda h, c, t: H.title(c), lambda h, c, t: H.page_links(t, b))
    assert row.c0 == "Test Page"
    assert row.c1 == [f"https://example.com/page{i}" for i in (1, 2, 3)]


def test_markup_inside_title_is_text(spark):
    b = lit(BASE)
    row = run(
        spark, '<title><a href="/x">t</a></title><a href="/y">y</a>', lambda h, c, t: H.title(c), lambda h, c, t: H.page_links(t, b)
    )
    assert row.c0 == '<a href="/x">t</a>'
    assert row.c1 == ["https://example.com/y"]


def test_unterminated_comment_and_script(spark):
    b = lit(BASE)
    row = run(
        spark,
        '<a href="/a">a</a><!-- <a href="/b">b</a>',
        lambda h, c, t: H.page_links(t, b),
    )
    assert row.c0 == ["https://example.com/a"]
    row = run(spark, '<a href="/a">a</a><script> <a href="/b">b</a>', lambda h, c, t: H.page_links(t, b))
    assert row.c0 == ["https://example.com/a"]


def test_unescape_matches_standard_library(spark):
    texts = ["&lt;a&gt;", "a &amp;&amp; b", "&nosuch; &", "&#0;&#xD800;&#x80;&#129;", "&hellip;&nbsp;x", "&&amp;", "&AMP;", "&frac12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u for r in df.select("t", F.expr(H.unescape("t")).alias("u")).collect()}
    assert got == {t: pyhtml.unescape(t) for t in texts}


def test_bare_entity_in_attribute_query(spark):
    row = run(spark, '<a href="/p?a=1&copy=2">x</a>', lambda h, c, t: H.anchor_hrefs(t))
    assert row.c0 == ["/p?a=1&copy=2"]


def test_needs_js_render(spark):
    long_text = "<html><body>" + "static words " * 80 + "</body></html>"
    cases = [
        ("<html><script>x()</script></html>", True),
        (long_text, False),
        ('<div id="root"></div><script src="react.js"></script>', True),
        (long_text + "javascript IS required", True),
        (long_text + '<DIV ID="APP"></DIV>', True),
    ]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h string")
    assert [r[0] for r in df.select(F.expr(H.needs_js_render("h"))).collect()] == [e for _, e in cases]

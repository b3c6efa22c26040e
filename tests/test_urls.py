import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from weblens.functions.core import lit
from weblens.functions import urls

BASE = "https://example.com/a/b/page.html?x=1"

CASES = [
    ("https://example.com/page1", BASE, "https://example.com/page1"),
    ("/page2", "https://example.com", "https://example.com/page2"),
    ("page3", "https://example.com", "https://example.com/page3"),
    ("page3", BASE, "https://example.com/a/b/page3"),
    ("../up", BASE, "https://example.com/a/up"),
    ("../../../up", BASE, "https://example.com/up"),
    ("./", BASE, "https://example.com/a/b/"),
    ("..", BASE, "https://example.com/a/"),
    ("/x/../y/./z", BASE, "https://example.com/y/z"),
    ("?b=2&a=1&gclid=z", BASE, "https://example.com/a/b/page.html?a=1&b=2"),
    ("?gclid=z", BASE, "https://example.com/a/b/page.html"),
    ("/p?", BASE, "https://example.com/p?"),
    ("/p?a", BASE, "https://example.com/p?a="),
    ("/p?a=2&a=1&b=x%20y", BASE, "https://example.com/p?a=2&a=1&b=x+y"),
    ("/p?a=1;b=2&c=3&d=%zz", BASE, "https://example.com/p?c=3"),
    ("/p?q=~*'", BASE, "https://example.com/p?q=~%2A%27"),
    ("//cdn.example.net/x", BASE, "https://cdn.example.net/x"),
    ("HTTP://Example.com/A", BASE, "http://Example.com/A"),
    ("/für", BASE, "https://example.com/f%C3%BCr"),
    ("/f%c3%bcr", BASE, "https://example.com/f%c3%bcr"),
    ("/the,", BASE, "https://example.com/the,"),
    ("/a b(1)", BASE, "https://example.com/a%20b%281%29"),
    ("/b(1)", BASE, "https://example.com/b(1)"),
    ("/a+b", BASE, "https://example.com/a+b"),
    ("/a+ü", BASE, "https://example.com/a+%C3%BC"),
    ("/p#frag", BASE, "https://example.com/p"),
    # An empty authority and an empty path refer to the document itself.
    ("//", BASE, "https://example.com/a/b/page.html?x=1"),
    ("/a//b", BASE, "https://example.com/a//b"),
    ("data:image/png;base64,AA==", BASE, "data:image/png;base64,AA=="),
    ("JavaScript:void(0)", BASE, "javascript:void(0)"),
    ("", BASE, None),
    ("#top", BASE, None),
    ("javascript:void(0)", BASE, None),
    ("mailto:a@b.c", BASE, None),
    ("tel:123", BASE, None),
    ("/bad%zz", BASE, None),
    ("1:2", BASE, None),
    (":x", BASE, None),
    ("http://host:port/", BASE, None),
    ("http://ho st/", BASE, None),
    ("/a\nb", BASE, None),
    ("http://[::1]:80/x", BASE, "http://[::1]:80/x"),
    ("https://user@example.com/x", BASE, "https://user@example.com/x"),
    ("https://example.com", BASE, "https://example.com"),
    ("page", "http://x.org/i.html#f", "http://x.org/page"),
    ("/a/b.c/d-e_f~g/", BASE, "https://example.com/a/b.c/d-e_f~g/"),
    ("/a/.b", BASE, "https://example.com/a/.b"),
    ("/a", "http://fü.org/", "http://f%C3%BC.org/a"),
    ("/a", "http://bad host/", None),
    ("http://x.org/a", "http://bad host/", None),
    ("/a", "file:///tmp/x", "file:///a"),
    ("http://x.org:80/a", BASE, "http://x.org:80/a"),
]


def _column(spark, rows, names, expr):
    df = spark.createDataFrame(rows, names)
    return [r[0] for r in df.select(expr).collect()]


def test_normalize_cases(spark):
    rows = [(i, h, b) for i, (h, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, h string, b string")
    got = {r.i: r.u for r in df.select("i", F.expr(urls.normalize_url("h", "b")).alias("u")).collect()}
    bad = [(CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2]]
    assert bad == []


def test_normalize_is_idempotent(spark):
    done = sorted({e for _, _, e in CASES if e and e.startswith("http") and not e.endswith("?")})
    df = spark.createDataFrame([(u,) for u in done], "u string")
    again = df.select("u", F.expr(urls.normalize_url("u", lit(BASE))).alias("v")).collect()
    assert [(r.u, r.v) for r in again if r.u != r.v] == []


def test_random_paths_match_the_standard_library(spark):
    rng = random.Random(11)
    parts = ["a", "b2", "c.html", ".", "..", ".x", "x~y", "..."]

    def path(least):
        return "/".join(rng.choice(parts) for _ in range(rng.randrange(least, 6)))

    rows = []
    for _ in range(3000):
        # The standard library drops empty first segments, which are kept here; none are made.
        base = f"http://h.org/{path(1)}{rng.choice(['', '/', '?q=1', '#f'])}"
        ref = rng.choice(["", "/"]) + path(1) + rng.choice(["", "/"])
        if rng.random() < 0.1:
            ref = f"https://{rng.choice(['x.org', 'x.org:80'])}/{ref.lstrip('/')}"
        rows.append((base, ref))
    df = spark.createDataFrame(rows, "b string, h string")
    got = df.select("b", "h", F.expr(urls.normalize_url("h", "b")).alias("u")).collect()
    # The library leaves dot segments in absolute references; joining the path again removes them.
    want = {(b, h): urljoin(urljoin(b, h), urlsplit(urljoin(b, h)).path) for b, h in rows}
    assert [tuple(r) for r in got if r.u != want[r.b, r.h]] == []


def test_resolve_keeps_fragment(spark):
    got = _column(
        spark,
        [("#f", "http://x.org/a?q=1"), ("", "http://x.org/a?q=1#g"), ("b#ü", "http://x.org/a")],
        "h string, b string",
        F.expr(urls.resolve_url("h", "b")),
    )
    assert got == ["http://x.org/a?q=1#f", "http://x.org/a?q=1#g", "http://x.org/b#%C3%BC"]


def test_strip_tracking(spark):
    got = _column(
        spark,
        [("http://x.org/a?utm_source=f",), ("http://x.org/a?z=1&fbclid=2&b=3#t",), ("http://x.org/",)],
        "u string",
        F.expr(urls.strip_tracking("u")),
    )
    assert got == ["http://x.org/a", "http://x.org/a?b=3&z=1#t", "http://x.org/"]


@pytest.mark.parametrize(
    "url,host,domain,path",
    [
        ("https://user@example.com:8080/a?b", "example.com:8080", "example.com", "/a"),
        ("http://my_host/a%20b", "my_host", "my_host", "/a b"),
        ("https://example.com", "example.com", "example.com", ""),
        ("mailto:x@y.z", "", "", "x@y.z"),
    ],
)
def test_parts(spark, url, host, domain, path):
    c = lit(url)
    row = spark.range(1).selectExpr(urls.url_host(c), urls.domain_no_port(c), urls.url_path(c)).first()
    assert tuple(row) == (host, domain, path)


def test_wildcard(spark):
    c = lit("  *.a.example.com ")
    assert spark.range(1).selectExpr(urls.strip_wildcard(c)).first()[0] == "a.example.com"

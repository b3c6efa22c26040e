import random
import time

import pytest

from weblens.operators.robots import robots_allowed, robots_decisions

AGENT = "LensBot"


def decide(spark, body, *paths, status=200):
    robots = spark.createDataFrame(
        [("http://x.org/robots.txt", status, body)], "robots_url string, status int, body string"
    )
    urls = spark.createDataFrame([(i, f"http://x.org{p}") for i, p in enumerate(paths)], "i int, url string")
    rows = sorted(robots_decisions(urls, robots, AGENT).collect(), key=lambda r: r.i)
    return [r.allowed for r in rows]


@pytest.mark.parametrize(
    "body,path,allowed",
    [
        ("", "/a", True),
        ("User-agent: *\nDisallow:", "/a", True),
        ("User-agent: *\nDisallow: /", "/a", False),
        ("User-agent: *\nDisallow: /", "", False),
        ("user-AGENT: *\r\nDISALLOW: /a\r\n", "/ab", False),
        ("User-agent: *\rDisallow: /a", "/ab", False),
        ("User-agent: *\nDisallow: /a\nAllow: /ab", "/abc", True),
        ("User-agent: *\nAllow: /a\nDisallow: /ab", "/abc", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/abc", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf2", True),
        ("User-agent: *\nDisallow: /a.b", "/axb", True),
        ("User-agent: *\nDisallow: /x*z", "/a/xyz", True),
        ("User-agent: lens\nDisallow: /a\nUser-agent: *\nDisallow: /b", "/a", False),
        ("User-agent: lens\nDisallow: /a\nUser-agent: *\nDisallow: /b", "/b", True),
        ("User-agent: lens\nDisallow: /a\nUser-agent: lensbot\nDisallow: /b", "/a", True),
        ("User-agent: lens\nUser-agent: other\nDisallow: /a", "/a", False),
        ("User-agent: lensbot\nDisallow: /a\n\nUser-agent: lensbot\nDisallow: /b", "/b", False),
        ("User-agent: lensbot2\nDisallow: /", "/a", True),
        ("Disallow: /", "/a", True),
        ("User-agent: * # all\nDisallow: /a # why", "/a", False),
        ("User-agent: *\nSitemap: http://x.org/s.xml\nDisallow: /a", "/a", False),
        ("User-agent: *\nCrawl-delay: 5\nUser-agent: other\nDisallow: /", "/a", True),
        ("User-agent: *\nDisallow: /für", "/f%C3%BCr", False),
        ("User-agent: *\nDisallow: /q", "/a?x=/q", True),
        ("<html>error</html>", "/a", True),
    ],
)
def test_rules(spark, body, path, allowed):
    assert decide(spark, body, path) == [allowed]


def test_status(spark):
    block = "User-agent: *\nDisallow: /"
    assert decide(spark, block, "/a", status=404) == [True]
    assert decide(spark, block, "/a", status=500) == [False]


def test_missing_file_allows(spark):
    robots = spark.createDataFrame([], "robots_url string, status int, body string")
    urls = spark.createDataFrame([("http://x.org/a",)], "url string")
    assert robots_allowed(urls, robots, AGENT).count() == 1


def brute_match(pattern, path):
    """A pattern against a path by trying every place for every star."""
    if pattern.endswith("$"):
        pattern, rest_may_follow = pattern[:-1], False
    else:
        rest_may_follow = True
    places = {0}
    for c in pattern:
        if c == "*":
            places = set(range(min(places), len(path) + 1)) if places else set()
        else:
            places = {p + 1 for p in places if p < len(path) and path[p] == c}
    return bool(places) if rest_may_follow else len(path) in places


def test_patterns_against_every_way_to_match(spark):
    draw = random.Random(6)
    patterns = {"/" + "".join(draw.choice("ab*/$") for _ in range(draw.randint(0, 6))) for _ in range(120)}
    paths = {"/" + "".join(draw.choice("ab/$") for _ in range(draw.randint(0, 7))) for _ in range(150)}
    rows = [(n, p) for n, p in enumerate(sorted(patterns))]
    robots = spark.createDataFrame([(f"http://h{n}.org/robots.txt", 200, f"User-agent: *\nDisallow: {p}") for n, p in rows], "robots_url string, status int, body string")
    urls = spark.createDataFrame([(n, q, f"http://h{n}.org{q}") for n, _ in rows for q in sorted(paths)], "n int, path string, url string")
    got = {(r.n, r.path): r.allowed for r in robots_decisions(urls, robots, AGENT).collect()}
    assert got == {(n, q): not brute_match(p, q) for n, p in rows for q in sorted(paths)}


def test_many_stars_take_no_time(spark):
    body = "User-agent: *\nDisallow: /" + "*a" * 30 + "*b$\n"
    start = time.time()
    assert decide(spark, body, "/" + "a" * 50_000, "/" + "a" * 50_000 + "b", "/" + "a" * 29 + "b") == [True, False, True]
    assert time.time() - start < 30  # job overhead included; backtracking would take for ever

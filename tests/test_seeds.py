import json

from weblens.sources import seeds, sitemaps


def files(spark, *rows):
    return spark.createDataFrame(rows, "sitemap_url string, status int, body string")


def test_locs(spark):
    body = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
    <url><loc> https://x.org/?a=1&amp;b=2
    </loc></url><url><LOC>https://x.org/2</LOC></url><url><loc>https://x.org/2</loc></url><location>no</location>"""
    rows = sitemaps.sitemap_locs(files(spark, ("s", 200, body))).collect()
    assert [(r.pos, r["loc"]) for r in rows] == [
        (0, "https://x.org/?a=1&b=2"), (1, "https://x.org/2"), (2, "https://x.org/2"),
    ]


def locs(*urls):
    return "".join(f"<loc>{u}</loc>" for u in urls)


def test_expand(spark):
    table = files(
        spark,
        ("http://x/sitemap.xml", 200, locs("http://x/a.xml", "http://x/b.xml", "http://x/missing.xml", "http://x/page")),
        ("http://x/a.xml", 200, locs("http://x/1", "http://x/sitemap.xml", "http://x/2")),
        ("http://x/b.xml", 500, locs("http://x/lost")),
        ("http://x/c.xml", 200, locs("http://x/unreached")),
        ("http://x/my-sitemap-page", 200, locs("http://x/3", "http://x/1")),
    )
    roots = spark.createDataFrame([("http://x/sitemap.xml",), ("http://x/my-sitemap-page",)], "sitemap_url string")
    got = sorted(r["loc"] for r in sitemaps.sitemap_index_expand(spark, roots, table).collect())
    assert got == ["http://x/1", "http://x/1", "http://x/2", "http://x/3", "http://x/page"]


def test_seed_sitemap_uses_robots(spark):
    robots = spark.createDataFrame(
        [("http://x/robots.txt", 200, "SiteMap:  http://x/extra.xml \n sitemap: http://x/no.xml\nUser-agent: *"),
         ("http://y/robots.txt", 200, "Sitemap: http://x/no.xml")],
        "robots_url string, status int, body string",
    )
    table = files(
        spark,
        ("http://x/sitemap_index.xml", 200, locs("http://x/1")),
        ("http://x/extra.xml", 200, locs("http://x/2")),
        ("http://x/no.xml", 200, locs("http://x/3")),
    )
    got = sorted(r.url for r in sitemaps.seed_sitemap(spark, "http://x/start?q", robots, table).collect())
    assert got == ["http://x/1", "http://x/2"]


def test_certificates(spark, tmp_path):
    dump = tmp_path / "ct.json"
    dump.write_text(
        json.dumps(
            [
                {"id": 1, "name_value": "www.example.com\n*.example.com"},
                {"id": 2, "name_value": "user@example.com\nother.org"},
                {"id": 3, "name_value": " testexample.com \nwww.example.com\nexample.com.evil.org"},
            ]
        )
    )
    records = seeds.read_certificates(spark, str(dump))
    got = sorted(r.url for r in seeds.seed_ct(records, "https://example.com:8443/x").collect())
    names = ["example.com", "testexample.com", "user@example.com", "www.example.com"]
    assert got == [f"https://{n}" for n in names]
    strict = seeds.seed_ct(records, "https://example.com", strict_domain=True).collect()
    assert sorted(r.url for r in strict) == ["https://example.com", "https://www.example.com"]


def test_crawl_index(spark, tmp_path):
    dump = tmp_path / "cc.jsonl"
    lines = [{"url": "http://a.org/2"}, {"url": "http://a.org/1"}, {"url": "http://a.org/1"}, {"url": ""}, {"url": "http://b.net/"}]
    dump.write_text("\n".join(json.dumps(x) for x in lines) + '\n{"url": "http://cut\n')
    index = seeds.read_crawl_index(spark, str(dump))
    assert sorted(r.url for r in seeds.seed_crawl_index(index).collect()) == ["http://a.org/1", "http://a.org/2", "http://b.net/"]
    assert [r.url for r in seeds.seed_crawl_index(index, "b.net").collect()] == ["http://b.net/"]
    assert [r.url for r in seeds.seed_crawl_index(index, "a.org", max_records=2).collect()] == ["http://a.org/1"]


def test_union_credits_the_first_strategy(spark):
    def urls(*names):
        return spark.createDataFrame([(n,) for n in names], "url string")

    parts = {"ct": urls("b", "c"), "sitemap": urls("a", "b", "b"), "crawl_index": urls("c", "d")}

    def union(strategy):
        return {r.url: r.strategy for r in seeds.seed_union(strategy, parts).collect()}

    assert union("all") == {"a": "sitemap", "b": "sitemap", "c": "ct", "d": "crawl_index"}
    assert union("crawl_index,unknown,ct") == {"b": "ct", "c": "crawl_index", "d": "crawl_index"}
    assert union("none") == {}
    counts = seeds.seed_counts(seeds.seed_union("all", parts)).collect()
    assert {r.strategy: r.added for r in counts} == {"sitemap": 2, "ct": 1, "crawl_index": 1}


def test_locs_in_comments_do_not_count_and_text_is_trimmed_after_decoding(spark):
    body = "<loc>&#10;https://x/pad&#9;</loc><!-- <loc>https://x/old</loc> --><loc>https://x/b</loc><!-- <loc>https://x/open</loc>"
    rows = sitemaps.sitemap_locs(files(spark, ("s", 200, body))).collect()
    assert [(r.pos, r["loc"]) for r in rows] == [(0, "https://x/pad"), (1, "https://x/b")]

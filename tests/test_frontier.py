import random
from collections import Counter, deque

from weblens.operators import frontier
from weblens.operators.seen import mark_seen
from weblens.plans.graph import breadth_first, crawl_depth_bfs, discovery_edges


def test_schedule_is_the_same_in_any_chunking(spark):
    rng = random.Random(1)
    rows = [(f"u{i}", "hot" if rng.random() < 0.5 else f"h{rng.randrange(5)}", i) for i in range(500)]
    queue = spark.createDataFrame(rows, "url string, host string, seq long")
    turn, first = Counter(), {}
    want = {}
    for url, host, seq in rows:
        turn[host] += 1
        first.setdefault(host, seq)
        want[url] = (turn[host], (turn[host] - 1) * 100, first[host])
    for chunk in (7, 100_000):
        got = frontier.politeness_schedule(queue, chunk_rows=chunk).collect()
        assert {r.url: (r.round, r.earliest_ms, r.host_first_seq) for r in got} == want


def test_new_and_pending_urls(spark):
    candidates = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "url string")
    seen = spark.createDataFrame([("b",)], "url string")
    assert sorted(r.url for r in frontier.frontier_new_urls(candidates, seen).collect()) == ["a", "c"]
    assert sorted(r.url for r in frontier.pending_urls(candidates, seen).collect()) == ["a", "a", "c"]


def test_scope(spark):
    links = spark.createDataFrame(
        [
            ("https://example.com/", "https://example.com/a"),
            ("https://example.com/", "https://sub.example.com/a"),
            ("https://example.com/", "https://testexample.com/a"),
            ("https://example.com/", "https://other.net/a"),
            ("https://example.com/", "ftp://example.com/a"),
            ("https://example.com/", "/relative"),
        ],
        "url string, link string",
    )

    def kept(**options):
        return [r.link for r in frontier.crawl_scope_filter(links, **options).collect()]

    assert kept() == [r[1] for r in links.collect()][:3]
    assert kept(strict_domain=True) == ["https://example.com/a", "https://sub.example.com/a"]
    assert len(kept(allow_external=True)) == 4


def test_frontier_stats(spark):
    found = spark.createDataFrame(
        [("http://a/1",), ("http://a/1",), ("http://a/2",), ("http://b/1",)], "url string"
    )
    done = spark.createDataFrame([("http://a/1", None), ("http://b/1", "x")], "url string, error string")
    rows = {r.host: (r.discovered, r.processed, r.pending, r.is_empty) for r in frontier.frontier_stats(found, done).collect()}
    assert rows == {"a": (2, 1, 1, False), "b": (1, 0, 0, True), None: (3, 1, 1, False)}


def brute_bfs(edges, seeds, max_depth=None):
    depth, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        node = queue.popleft()
        if max_depth is not None and depth[node] >= max_depth:
            continue
        for source, target in edges:
            if source == node and target not in depth:
                depth[target] = depth[node] + 1
                queue.append(target)
    return depth


def test_breadth_first_with_a_hub(spark):
    rng = random.Random(2)
    nodes = [f"n{i:03}" for i in range(150)]
    # A third of all edges leave one hub, a third enter one.
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(120)]
    edges += [("n000", rng.choice(nodes)) for _ in range(60)] + [(rng.choice(nodes), "n001") for _ in range(60)]
    seeds = spark.createDataFrame([("n000",), ("n149",), ("n000",)], "url string")
    graph = spark.createDataFrame(edges, "source_url string, target_url string")
    for limit in (None, 2):
        want = brute_bfs(edges, ["n000", "n149"], limit)
        rows = breadth_first(spark, seeds, graph, limit).collect()
        assert {r.url: r.depth for r in rows} == want and len(rows) == len(want)
        for r in rows:
            parents = [s for s, t in edges if t == r.url and want.get(s) == r.depth - 1]
            assert r.parent_url == (min(parents) if r.depth else None)


def test_long_chain_merges_rounds(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    graph = spark.createDataFrame(edges, "source_url string, target_url string")
    rows = breadth_first(spark, spark.createDataFrame([("c0",)], "url string"), graph).collect()
    assert {r.url: r.depth for r in rows} == {f"c{i}": i for i in range(21)}


def test_crawl_stays_in_scope(spark):
    links = spark.createDataFrame(
        [("http://a.x/1", "http://a.x/2"), ("http://a.x/2", "http://b.y/1"), ("http://a.x/2", "http://a.x/1")],
        "source_url string, target_url string",
    )
    seeds = spark.createDataFrame([("http://a.x/1",)], "url string")
    crawled = crawl_depth_bfs(spark, seeds, links)
    assert sorted(r.url for r in crawled.collect()) == ["http://a.x/1", "http://a.x/2"]
    assert [tuple(r) for r in discovery_edges(crawled).collect()] == [("http://a.x/1", "http://a.x/2", 1)]


def test_seen_probe(spark):
    seen = spark.range(2_000).selectExpr("concat('https://example.com/', id % 1000) as url")
    fresh = spark.range(2_000, 6_000).selectExpr("concat('https://example.com/', id) as url")
    assert mark_seen(seen, seen).where("maybe_seen").count() == 2_000
    assert mark_seen(fresh, seen).where("not maybe_seen").count() == 4_000
    odd = spark.createDataFrame([(None,), ("a",), ("a",)], "url string")
    assert [r.maybe_seen for r in mark_seen(odd, odd).orderBy("url").collect()] == [False, True, True]

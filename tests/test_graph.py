"""Multi-hop traversal: many cells, hubs, long chains."""

import random
from collections import deque

import pytest

from weblens.plans import graph
from weblens.plans.graph import breadth_first


def brute(edges, seeds, max_depth=None):
    links = {}
    for s, t in edges:
        if s is not None and t is not None:
            links.setdefault(s, []).append(t)
    depth, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        node = queue.popleft()
        if max_depth is not None and depth[node] >= max_depth:
            continue
        for t in links.get(node, ()):
            if t not in depth:
                depth[t] = depth[node] + 1
                queue.append(t)
    parent = {}
    for s, ts in links.items():
        for t in ts:
            if s in depth and depth.get(t) == depth[s] + 1 and (t not in parent or s < parent[t]):
                parent[t] = s
    return {n: (d, parent.get(n) if d else None) for n, d in depth.items()}


def reached(spark, edges, seeds, limit=None, **options):
    graph_ = spark.createDataFrame(edges, "source_url string, target_url string")
    rows = breadth_first(spark, spark.createDataFrame([(s,) for s in seeds], "url string"), graph_, limit, **options).collect()
    assert len(rows) == len({r.url for r in rows})
    return {r.url: (r.depth, r.parent_url) for r in rows}


@pytest.fixture
def turns(monkeypatch):
    seen = []
    plain = graph._round
    monkeypatch.setattr(graph, "_round", lambda limit, turn: (seen.append(turn), plain(limit, turn))[1])
    return seen


@pytest.mark.parametrize("cell_links", [40, 500_000])
def test_hubs_and_cells(spark, cell_links):
    rng = random.Random(cell_links)
    nodes = [f"http://h{i % 7}.org/{i}" for i in range(150)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(160)]
    edges += [(nodes[0], rng.choice(nodes)) for _ in range(150)] + [(rng.choice(nodes), nodes[1]) for _ in range(60)]
    edges += [(None, nodes[0]), (nodes[0], None), (nodes[3], nodes[3])]
    seeds = [nodes[5], nodes[149], "http://alone.org/"]
    for limit in (None, 2, 0):
        assert reached(spark, edges, seeds, limit, cell_links=cell_links) == brute(edges, seeds, limit)


def test_chain_of_two_thousand_nodes_takes_few_rounds(spark, turns):
    edges = [(f"http://a.org/{i:05}", f"http://a.org/{i + 1:05}") for i in range(2000)]
    edges += [("http://a.org/00000", f"http://b.org/{i:05}") for i in range(600)]  # a hub with slices
    got = reached(spark, edges, ["http://a.org/00000"], cell_links=500)
    assert got == brute(edges, ["http://a.org/00000"])
    assert len(turns) <= 20


def test_waves_that_overtake_each_other(spark):
    # A long way inside a cell is corrected by a short one through another cell.
    inside = [(f"http://a.org/{i:03}", f"http://a.org/{i + 1:03}") for i in range(60)]
    around = [("http://a.org/000", "http://z.org/1"), ("http://z.org/1", "http://a.org/050"), ("http://a.org/059", "http://z.org/2")]
    edges = inside + around
    assert reached(spark, edges, ["http://a.org/000"], cell_links=61) == brute(edges, ["http://a.org/000"])


def test_nothing_to_do(spark):
    assert reached(spark, [], ["http://a.org/"]) == {"http://a.org/": (0, None)}
    assert reached(spark, [("a", "b")], []) == {}


def test_links_are_not_shuffled_in_a_round(spark, tmp_path):
    """A round's plan has no exchange between the bucketed links and the cogroup."""
    cells = spark.createDataFrame([(i, 1, None, None, None, None) for i in range(50)], "cell long, nodes int, source binary, target_cell binary, target binary, step binary")
    cells.write.bucketBy(8, "cell").option("path", str(tmp_path / "cells")).format("parquet").saveAsTable("cells_plan")
    try:
        mail = spark.createDataFrame([], graph._MAIL)
        done = spark.table("cells_plan").groupBy("cell").cogroup(mail.groupBy("cell")).applyInPandas(graph._round(5, 1), graph._MAIL)
        plan = done._jdf.queryExecution().executedPlan().toString()
        scan = next(n for n, line in enumerate(plan.splitlines()) if "FileScan" in line)
        above = [line for line in plan.splitlines()[:scan] if "Exchange" in line]
        assert "Bucketed: true" in plan and not above
    finally:
        spark.sql("DROP TABLE cells_plan")

"""Breadth-first traversal of a link graph, many hops a round.

Nodes are placed once, in cells of bounded size: ranges of (host, URL), as most links
lead to the same host and to neighbouring paths. A cell's out-links are one row of a
table bucketed by cell, so they are never shuffled again. In a round every cell that
was written to lowers the depths of its own nodes until nothing changes, however many
hops that takes, and sends one message to each other cell that it reaches: the nodes
whose depth fell and their new depths. A round therefore costs what changed, and the
number of rounds is that of crossings between cells on a path, not that of its hops.

A node with more out-links than a cell holds (a hub) keeps them in cells of its own, one
for each slice, which learn the hub's depth by messages like any other cell.
"""

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.functions.urls import url_host
from weblens.operators.frontier import crawl_scope_filter
from weblens.shipping import ship_package
from weblens.workspace import Workspace

CELL_LINKS = 500_000
_MERGE_ROUNDS = 16
_ACTIVE_LISTED = 200  # cells named in a filter; beyond that a semi join finds them
_UNREACHED = np.iinfo(np.int32).max
_IDX_BITS, _COPY_BITS = 24, 18

_MAIL = "cell long, turn int, idx binary, depth binary, kind int"
_STATE, _MESSAGE = 0, 1


# --- inside a cell ---------------------------------------------------------------


def _ints(data: bytes | None, kind=np.int32) -> np.ndarray:
    return np.frombuffer(data, kind) if data else np.zeros(0, kind)


class _Cell:
    """The out-links of a cell, by source."""

    def __init__(self, row):
        self.nodes = int(row.nodes)
        self.source, self.target = _ints(row.source), _ints(row.target)
        self.target_cell, self.step = _ints(row.target_cell, np.int64), _ints(row.step, np.int8)
        self.begin = np.searchsorted(self.source, np.arange(self.nodes + 1))
        self.own = self.target_cell == int(row.cell)

    def links(self, nodes: np.ndarray) -> np.ndarray:
        """Positions of the out-links of some nodes."""
        sizes = self.begin[nodes + 1] - self.begin[nodes]
        first = np.repeat(self.begin[nodes] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes)
        return first + np.arange(len(first))

    def relax(self, depth: np.ndarray, idx: np.ndarray, new: np.ndarray, max_depth: int) -> np.ndarray:
        """Lower ``depth`` by the given candidates until nothing changes; the nodes whose depth fell."""
        before = depth.copy()
        np.minimum.at(depth, idx, new)
        fell = np.unique(idx[depth[idx] < before[idx]])
        pending: dict[int, list[np.ndarray]] = {}
        for level in np.unique(depth[fell]):
            pending[int(level)] = [fell[depth[fell] == level]]
        while pending:
            level = min(pending)
            nodes = np.unique(np.concatenate(pending.pop(level)))
            nodes = nodes[depth[nodes] == level]
            if level >= max_depth:
                continue
            links = self.links(nodes)
            targets = self.target[links[self.own[links]]]
            targets = np.unique(targets[depth[targets] > level + 1])
            if len(targets):
                depth[targets] = level + 1
                pending.setdefault(level + 1, []).append(targets)
        return np.flatnonzero(depth < before)

    def messages(self, depth: np.ndarray, fell: np.ndarray, max_depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, nodes, depths) for the other cells that the fallen nodes lead to."""
        links = self.links(fell)
        links = links[~self.own[links]]
        found = depth[self.source[links]] + self.step[links]
        links, found = links[found <= max_depth], found[found <= max_depth]
        order = np.lexsort((found, self.target[links], self.target_cell[links]))
        links, found = links[order], found[order]
        cells, nodes = self.target_cell[links], self.target[links]
        least = np.ones(len(links), bool)
        least[1:] = (cells[1:] != cells[:-1]) | (nodes[1:] != nodes[:-1])
        cells, nodes, found = cells[least], nodes[least], found[least]
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else []
        for a, b in zip(starts, [*starts[1:], len(cells)]):
            yield int(cells[a]), nodes[a:b], found[a:b].astype(np.int32)


def _round(max_depth: int, turn: int):
    """One round of a cell: its links on one side, its state and messages on the other."""

    def run(cells: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        out = []
        messages = mail[mail["kind"] == _MESSAGE]
        if len(cells) and len(messages):
            cell = _Cell(next(cells.itertuples()))
            states = mail[mail["kind"] == _STATE]["depth"]
            depth = _ints(states.iloc[0]).copy() if len(states) else np.full(cell.nodes, _UNREACHED, np.int32)
            idx = np.concatenate([_ints(m) for m in messages["idx"]])
            new = np.concatenate([_ints(m) for m in messages["depth"]])
            fell = cell.relax(depth, idx, new, max_depth)
            if len(fell):
                out.append((int(cells["cell"].iloc[0]), turn, None, depth.tobytes(), _STATE))
                out += [(c, turn, i.tobytes(), d.tobytes(), _MESSAGE) for c, i, d in cell.messages(depth, fell, max_depth)]
        return pd.DataFrame(out, columns=["cell", "turn", "idx", "depth", "kind"])

    return run


def _build():
    """The links of one cell as one row, by source."""

    def run(links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values("s_idx")
        return pd.DataFrame(
            {
                "cell": [links["s_cell"].iloc[0]],
                "source": [links["s_idx"].to_numpy(np.int32).tobytes()],
                "target_cell": [links["t_cell"].to_numpy(np.int64).tobytes()],
                "target": [links["t_idx"].to_numpy(np.int32).tobytes()],
                "step": [links["step"].to_numpy(np.int8).tobytes()],
            }
        )

    return run


def _offers(max_depth: int):
    """Of each cell's links the least (depth, source) for each target: (t_cell, t_idx, depth, s_cell, s_idx)."""

    def run(cells: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        columns = ["t_cell", "t_idx", "depth", "s_cell", "s_idx"]
        if not len(cells) or not len(states):
            return pd.DataFrame(columns=columns)
        row = next(cells.itertuples())
        cell, depth = _Cell(row), _ints(states["depth"].iloc[0])
        known = (depth[cell.source] < max_depth) & (cell.step == 1)
        out = pd.DataFrame(
            {"t_cell": cell.target_cell[known], "t_idx": cell.target[known], "depth": depth[cell.source[known]] + 1, "s_cell": int(row.cell), "s_idx": cell.source[known]}
        )
        if row.cell < 0:  # a slice of a hub: the source is the hub where it lives
            code = -int(row.cell) - 1
            out["s_cell"] = code >> (_IDX_BITS + _COPY_BITS)
            out["s_idx"] = (code >> _COPY_BITS) & ((1 << _IDX_BITS) - 1)
        return out.sort_values(["depth", "s_idx"], kind="stable").drop_duplicates(["t_cell", "t_idx"])

    return run


# --- the traversal ----------------------------------------------------------------


def _placed(space: Workspace, nodes: DataFrame, cells: int) -> DataFrame:
    """(url, cell, idx): cells are ranges of (host, url); idx rises with the URL inside a cell."""
    ranged = nodes.withColumn("host", F.coalesce(F.expr(url_host("url")), F.lit("")))
    # A written row number: range bounds are sampled, and every use must see the same ones.
    ranged = ranged.repartitionByRange(cells, "host", "url").sortWithinPartitions("url")
    numbered = ranged.select("url", F.monotonically_increasing_id().alias("id"))
    return space.table("nodes", numbered.select("url", F.expr("id >> 33").alias("cell"), F.expr("cast(id & ((1L << 33) - 1) as int)").alias("idx")))


def _linked(space: Workspace, edges: DataFrame, nodes: DataFrame, cell_links: int) -> DataFrame:
    """Links between placed nodes (s_cell, s_idx, t_cell, t_idx, step), hubs cut into slices."""
    source = nodes.select(F.col("url").alias("source_url"), F.col("cell").alias("s_cell"), F.col("idx").alias("s_idx"))
    target = nodes.select(F.col("url").alias("target_url"), F.col("cell").alias("t_cell"), F.col("idx").alias("t_idx"))
    links = edges.join(source, "source_url").join(target, "target_url").select("s_cell", "s_idx", "t_cell", "t_idx")
    links = space.table("links", links)
    hubs = links.groupBy("s_cell", "s_idx").count().where(F.col("count") > cell_links)
    hubs = space.table("hubs", hubs.select("s_cell", "s_idx", F.ceil(F.col("count") / cell_links).cast("long").alias("slices")))

    def slice_cell(number: str) -> F.Column:
        return F.expr(f"-(s_cell * {1 << (_IDX_BITS + _COPY_BITS)}L + cast(s_idx as long) * {1 << _COPY_BITS}L + {number}) - 1")

    joined = links.join(hubs, ["s_cell", "s_idx"], "left").withColumn("copy", F.expr("pmod(xxhash64(t_cell, t_idx), slices)"))
    plain = joined.select(
        F.when(F.col("slices").isNull(), F.col("s_cell")).otherwise(slice_cell("copy")).alias("s_cell"),
        F.when(F.col("slices").isNull(), F.col("s_idx")).otherwise(0).alias("s_idx"),
        "t_cell", "t_idx", F.lit(1).alias("step"),
    )
    copies = hubs.withColumn("copy", F.explode(F.expr("sequence(0L, slices - 1)")))
    return plain.union(copies.select("s_cell", "s_idx", slice_cell("copy").alias("t_cell"), F.lit(0).alias("t_idx"), F.lit(0).alias("step")))


def breadth_first(
    spark: SparkSession, seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, cell_links: int = CELL_LINKS
) -> DataFrame:
    """Nodes reachable from ``seeds`` (column ``url``) with least depth and least parent of the level above.

    ``edges`` has source_url and target_url; rows with a null in either are no links. Every
    round is written to the shared folder; the driver sees the cells that were written to.
    A lost executor repeats the round it was in. Finished rounds are merged now and then.
    """
    ship_package()
    space = Workspace(spark, "bfs")
    limit = min(max_depth if max_depth is not None else _UNREACHED - 1, _UNREACHED - 1)
    edges = space.table("edges", edges.select("source_url", "target_url").where("source_url is not null and target_url is not null").distinct())
    start = space.table("seeds", seeds.select("url").where("url is not null").distinct())
    every = edges.select(F.col("source_url").alias("url")).union(edges.select("target_url")).union(start).distinct()
    cells = max(1, -(-edges.count() // cell_links))
    nodes = _placed(space, every, cells)

    links = _linked(space, edges, nodes, cell_links)
    built = links.groupBy("s_cell").applyInPandas(_build(), "cell long, source binary, target_cell binary, target binary, step binary")
    sizes = nodes.groupBy("cell").agg(F.count("*").cast("int").alias("nodes"))
    table = f"weblens_cells_{uuid.uuid4().hex}"
    packed = built.join(sizes, "cell", "full").select("cell", F.coalesce("nodes", F.lit(1)).alias("nodes"), "source", "target_cell", "target", "step")
    buckets = min(cells, 4096)
    packed.write.bucketBy(buckets, "cell").option("path", space.file("cells")).format("parquet").saveAsTable(table)
    try:
        return _traverse(spark, space, spark.table(table), nodes, start, limit)
    finally:
        spark.sql(f"DROP TABLE {table}")  # the catalog's entry; its files stay in the shared folder


def _traverse(spark: SparkSession, space: Workspace, cells: DataFrame, nodes: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    reader = spark.read.schema(_MAIL)
    starts = nodes.join(seeds, "url").select("cell", "idx")
    first = starts.groupBy("cell").agg(F.collect_list("idx").alias("nodes"))  # no more than a cell's nodes
    first.mapInPandas(_first_messages, _MAIL).write.partitionBy("kind").parquet(space.file("turn-0"))
    held: list[str] = []  # folders with the states of the cells
    turn = 0

    def states() -> DataFrame:
        every = [reader.parquet(space.file(f)).where(F.col("kind") == _STATE) for f in held]
        return reduce(DataFrame.union, every) if every else reader.parquet(space.file("turn-0")).limit(0)

    while True:
        mail = reader.parquet(space.file(f"turn-{turn}")).where(F.col("kind") == _MESSAGE)
        listed = [r["cell"] for r in mail.select("cell").distinct().limit(_ACTIVE_LISTED + 1).collect()]
        if not listed:
            break
        known, some = states(), cells
        if len(listed) <= _ACTIVE_LISTED:
            known, some = (frame.where(F.col("cell").isin(listed)) for frame in (known, cells))
        else:
            known = known.join(mail.select("cell").distinct(), "cell", "left_semi").select(*mail.columns)
        turn += 1
        inbox = mail.unionByName(_newest(known))
        done = some.groupBy("cell").cogroup(inbox.groupBy("cell")).applyInPandas(_round(limit, turn), _MAIL)
        done.write.partitionBy("kind").parquet(space.file(f"turn-{turn}"))
        held.append(f"turn-{turn}")
        if len(held) > _MERGE_ROUNDS:
            _newest(states()).write.partitionBy("kind").parquet(space.file(f"merged-{turn}"))
            held = [f"merged-{turn}"]
    offers = cells.groupBy("cell").cogroup(_newest(states()).groupBy("cell")).applyInPandas(_offers(limit), "t_cell long, t_idx int, depth int, s_cell long, s_idx int")
    source = nodes.select(F.col("cell").alias("s_cell"), F.col("idx").alias("s_idx"), F.col("url").alias("parent_url"))
    found = offers.join(source, ["s_cell", "s_idx"]).select(F.col("t_cell").alias("cell"), F.col("t_idx").alias("idx"), "depth", "parent_url")
    found = found.unionByName(starts.select("cell", "idx", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url")))
    best = found.groupBy("cell", "idx").agg(F.min(F.struct("depth", "parent_url")).alias("best"))
    answers = best.join(nodes, ["cell", "idx"]).select("url", "best.parent_url", "best.depth")
    return space.table("reached", answers)


def _first_messages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        idx = [np.asarray(nodes, np.int32) for nodes in frame["nodes"]]
        yield pd.DataFrame(
            {"cell": frame["cell"], "turn": 0, "idx": [i.tobytes() for i in idx], "depth": [np.zeros_like(i).tobytes() for i in idx], "kind": _MESSAGE}
        )


def _newest(states: DataFrame) -> DataFrame:
    """The last state of each cell."""
    newest = states.groupBy("cell").agg(F.max("turn").alias("turn"), F.max_by("depth", "turn").alias("depth"))
    return newest.select("cell", "turn", F.lit(None).cast("binary").alias("idx"), "depth", F.lit(_STATE).alias("kind"))


def crawl_depth_bfs(
    spark: SparkSession,
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int | None = None,
    allow_external: bool = False,
) -> DataFrame:
    """(url, depth, parent_url) of every page a crawl from ``seeds`` reaches, least depth first."""
    scoped = crawl_scope_filter(
        links.select(F.col("source_url").alias("url"), F.col("target_url").alias("link")),
        allow_external,
    )
    edges = scoped.select(F.col("url").alias("source_url"), F.col("link").alias("target_url"))
    return breadth_first(spark, seeds, edges, max_depth).select("url", "depth", "parent_url")


def discovery_edges(crawled: DataFrame) -> DataFrame:
    """(parent_url, url, depth) of the newly discovered pages of a traversal."""
    return crawled.where("parent_url is not null").select("parent_url", "url", "depth")

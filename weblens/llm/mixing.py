"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations.

Sizes are words. Each source gets a target: its share of all words by weight, at
most ``cap`` times its own words, what is above being reshared by weight. A source
whose target is r times its words gives every document floor(r) whole copies, for
certain. The rest of the target is a sample of fixed size in words: documents are
ranked by Pareto keys, the odds of a uniform draw divided by the odds of the
document's inclusion, and taken in that order until the next would pass the target.
Up to two more documents of each source, each the one whose size closes the remaining
gap best, take the last places if that brings the total nearer. Inclusion probabilities differ
between sources, and within a source with ``weight`` (1 by default).

Nothing is sorted per source: keys are cut into cells, cell totals (summed before
the shuffle) show in which cell the target is reached, the cells of that one are
looked at again, and at last single keys of a cell some 16 million times narrower
than the source. Ranks follow from the key alone, so the decision about any row
needs one row per source.

A null text has size 0. A null source is a source of its own, last in order. Rows
that share source and doc_id share one draw and go together. Documents of size 0
are taken with 0 words. An empty table gives an empty one.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblens.llm.common import WORD, as_row, uniform, workspace

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
CELLS = 4096
CLOSINGS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of the sources (source, source_size, one row each).

    With sources ordered by cap * size / weight, those that stop at the cap are a
    prefix: while what is left, shared by weight, exceeds a source's cap, it stops.
    The sources are one small table; its ranks need one order of all of them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("ceiling", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    levels = levels.withColumn("stopped", F.col("level") * F.col("weight") >= F.col("ceiling"))
    common = F.min(F.when(~F.col("stopped"), F.struct(F.col("ceiling") / F.col("weight"), "rank", "level"))).over(whole)
    return levels.select(
        "source", "source_size",
        F.when(F.col("stopped"), F.col("ceiling")).otherwise(common["level"] * F.col("weight")).alias("target"),
    )


def draws(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """Adds size and draw_odds: the odds of the row's draw, divided by its weight's odds factor.

    The inclusion odds of a source are a common factor of its rows, so they do not
    change ranks inside the source; they are applied with the source's table.
    """
    u = uniform(F.col("source"), F.col("doc_id"), seed=seed)
    odds = u / (F.lit(1.0) - u)
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("draw_odds", odds / (weight if weight is not None else F.lit(1.0)))


def plan(drawn: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, label: str = "mix") -> DataFrame:
    """One row per source: source, source_size, target, copies, inclusion, next_key, extras.

    ``drawn`` has source, size, draw_odds and doc_id. A row is taken ``copies`` times,
    and once more when its Pareto key is below ``next_key`` or one of ``extras``.
    """
    space = workspace(drawn.sparkSession, label)
    rows = space.table("drawn", drawn.select("source", "doc_id", "size", "draw_odds"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = targets(sizes, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = table.withColumn("copies", F.floor(ratio).cast("long"))
    table = table.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    table = table.withColumn(
        "inclusion",
        F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)),
    )
    table = space.table("sources", table)

    # The Pareto key of a row; p / (1 + p) spreads it over (0, 1) for the cells.
    some = table.where("inclusion > 0 and inclusion < 1").select(
        F.col("source").alias("_source"), "inclusion", "rest"
    )
    keyed = rows.join(some, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("key", pareto_key(F.col("draw_odds"), F.col("inclusion")))
    place = F.col("key") / (F.lit(1.0) + F.col("key"))
    keyed = keyed.withColumn("cell", F.least(F.floor(place * CELLS * CELLS), F.lit(CELLS * CELLS - 1)).cast("long"))

    def passed(totals: DataFrame, by: str, start: str) -> DataFrame:
        """Running totals per source; the first entry at which the rest of the target is passed."""
        running = Window.partitionBy("source").orderBy(by)
        totals = totals.withColumn("until", F.col(start) + F.sum("words").over(running))
        return (
            totals.where(F.col("until") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct(by, (F.col("until") - F.col("words")).alias("before"))).alias("at"))
            .select("source", F.col(f"at.{by}").alias(by), F.col("at.before").alias("before"))
        )

    coarse = F.floor(F.col("cell") / CELLS).cast("long")
    first = keyed.groupBy("source", coarse.alias("band"), "rest").agg(F.sum("size").alias("words"))
    first = passed(first.withColumn("start", F.lit(0)), "band", "start")
    inside = keyed.withColumn("band", coarse)
    second = _in(inside, first, "band").groupBy("source", "cell", "rest", "before").agg(F.sum("size").alias("words"))
    second = passed(second, "cell", "before")
    third = _in(inside, second, "cell").groupBy("source", "key", "rest", "before").agg(F.sum("size").alias("words"))
    third = passed(third, "key", "before")
    cuts = space.table("cuts", third.select(F.col("source").alias("_source"), F.col("key").alias("next_key"), F.col("before").cast("long").alias("taken")))

    # Of the rows that are left, those whose sizes close the remaining gap best, one by one.
    left = keyed.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("key") >= F.col("next_key"))
    left = left.groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("taken").alias("taken"))
    extras = cuts.select(F.col("_source").alias("_s"), F.array().cast("array<double>").alias("extras"), F.lit(0).cast("long").alias("closed"))
    for turn in range(CLOSINGS):
        open_rows = left.join(extras, F.col("source").eqNullSafe(F.col("_s"))).where(~F.array_contains("extras", F.col("key")))
        gap = F.col("rest") - F.col("taken") - F.col("closed")
        off = F.struct(F.abs(F.col("words") - gap).alias("off"), F.col("key").alias("key"), gap.alias("gap"), F.col("words").alias("words"))
        best = open_rows.groupBy("source").agg(F.min(off).alias("b")).where("b.off < b.gap").select(F.col("source").alias("_b"), "b")
        extras = extras.join(best, F.col("_s").eqNullSafe(F.col("_b")), "left").select(
            "_s",
            F.when(F.col("b").isNull(), F.col("extras")).otherwise(F.concat("extras", F.array("b.key"))).alias("extras"),
            (F.col("closed") + F.coalesce("b.words", F.lit(0))).alias("closed"),
        )
        extras = space.table(f"extras-{turn}", extras)
    out = table.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").join(
        extras, F.col("source").eqNullSafe(F.col("_s")), "left"
    )
    return space.table("plan", out.select("source", "source_size", "target", "copies", "inclusion", "next_key", "extras"))


def _in(rows: DataFrame, found: DataFrame, by: str) -> DataFrame:
    f = found.select(F.col("source").alias("_s"), F.col(by).alias("_by"), "before")
    return rows.join(f, F.col("source").eqNullSafe(F.col("_s")) & (F.col(by) == F.col("_by"))).drop("_s", "_by")


def pareto_key(odds: Column, inclusion: Column) -> Column:
    """Null where the inclusion is 0 or 1: such rows are not drawn."""
    return F.try_divide(odds, F.try_divide(inclusion, F.lit(1.0) - inclusion))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, weight: Column | None = None, seed: str = SEED, label: str = "mix") -> DataFrame:
    """``docs`` (doc_id, source, text, any others) with size, source_size, target, times and taken.

    ``times`` is how often the mix takes the row, ``taken`` the words that makes. A column of
    ``docs`` with one of these names is replaced; ``weight`` is an expression of doc_id, source and text.
    """
    added = ["size", "source_size", "target", "times", "taken"]
    kept = [c for c in docs.columns if c not in added]
    drawn = draws(as_row(docs, "doc_id", "source", "text"), weight, seed)
    decided = plan(drawn, weights, cap, label).withColumnRenamed("source", "_source")
    joined = drawn.join(decided, F.col("source").eqNullSafe(F.col("_source")), "left")
    key = pareto_key(F.col("draw_odds"), F.col("inclusion"))
    partial = (F.col("inclusion") > 0) & (F.col("inclusion") < 1)
    below = F.coalesce(partial & (F.col("next_key").isNull() | (key < F.col("next_key"))), F.lit(False))
    extra = F.coalesce(partial & F.array_contains("extras", key), F.lit(False))
    times = F.least(F.col("copies") + F.when(below | extra, 1).otherwise(0), F.lit(cap)).cast("long")
    out = joined.withColumn("times", times).withColumn("taken", F.col("size") * times)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)

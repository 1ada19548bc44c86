"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document i of source s gets a rate r_i of at most CAP, the one nearest to 1 in relative entropy among those that
meet the source's constraint on tokens:

    sum_i size_i r_i = target_s

Its solution is exponentially tilted, r_i = min(CAP, exp(b_s z_i)) with z_i = size_i / mean size, and b_s minimises a
convex dual. `tilt` finds it by Newton steps kept inside a bracket: each is one aggregation of moments over the
compact histogram (source, size, count), joined to a table of one row a source; nothing but "is any source still open?"
reaches the driver, so there may be any number of sources. Moments are summed as decimals, so reruns agree whatever order
tasks end in. A source whose target is all its tokens CAP times has the rate CAP.

`copies` rounds rates into whole copies: along each source's sizes, a size class of n documents gets
floor(R + 1/2) copies less what came before it, R the running sum of rates, so that rounding errors of neighbouring sizes
cancel and a source misses its target by at most its longest document. Then one copy of the size that best fills what is
missing changes at a time, in all sources at once, until none gets nearer to its target. Within a class, the
documents of the smallest hash rank get the odd copies; the ranks of a hot class are dealt out over several tasks, as
many as it has shares HOT of all rows. No document gets more than CAP copies.

Nulls and edges: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 and
sources without words have target 0 and rate 1 (they take 0 words whatever their copies); repeated rows are documents
each; other columns pass only through `mix_documents`; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.llm import common
from credence.llm.common import WORD, materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
TOLERANCE, STEPS = 1e-9, 100


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ranked_sources(totals: DataFrame) -> DataFrame:
    """totals with `rank`, from 0, of each source by code point, null last: a place in its range, and the ranges before."""
    inside = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # An id counts a partition's rows in its lower 33 bits.
    placed = materialise(inside.withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("k"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(2**33 - 1)).drop("part", "place", "before")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n, total, target: `share` of all sizes by weight, capped, the excess reshared until none is above.

    Each round needs one number, the words for a unit of weight; it only rises, so a source once above stays above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialise(ranked_sources(totals).withColumn("weight", weight), "weights")
    unit = 0.0
    while True:
        over = F.col("weight") * unit > cap * F.col("total")
        sums = rows.agg(F.sum("total").alias("all"), F.sum(F.when(over, F.col("total"))).alias("over"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not sums["free"]:
            break
        new = (share * (sums["all"] or 0) - cap * (sums["over"] or 0)) / sums["free"]
        if new <= unit:
            break
        unit = new
    target = F.least(F.col("weight") * unit, cap * F.col("total").cast("double"))
    return rows.select("source", "n", "total", target.alias("target"))


def tilt(histogram: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """source, b, scale, full of each source: rate cap if full, else min(cap, exp(b * size / scale)).

    histogram: source, size, n; goals: source, n, total, target.
    """
    some = F.col("total") > 0
    full = some & (F.col("target") >= cap * F.col("total") * (1 - tolerance))
    state = goals.select("source", "target", F.when(some, F.col("total") / F.col("n")).otherwise(1.0).alias("scale"), full.alias("full"), (some & ~full & (F.col("target") > 0)).alias("live"))
    state = materialise(state.select("*", F.lit(0.0).alias("b"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")), "state")
    for _ in range(steps):
        if state.filter("live").isEmpty():
            break
        state = materialise(_newton(state, _moments(histogram, state, cap), tolerance), "state")
    return state.select("source", "b", "scale", "full")


def _moments(histogram: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """m_source, m1 and m2, sums of r z and r z^2 (the latter of rates below the cap), of the live sources."""
    live = state.filter("live").select(F.col("source").alias("m_source"), "b", "scale")
    rows = histogram.join(live, _same("source", "m_source")).select("m_source", "n", (F.col("size") / F.col("scale")).alias("z"), "b")
    e = F.col("b") * F.col("z")
    bound = e >= math.log(cap)
    r = F.col("n") * F.when(bound, cap).otherwise(F.exp(F.least(e, F.lit(math.log(cap)))))
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
    return rows.groupBy("m_source").agg(exact(r * F.col("z")).alias("m1"), exact(F.when(bound, 0.0).otherwise(r * F.col("z") * F.col("z"))).alias("m2"))


def _newton(state: DataFrame, moments: DataFrame, tolerance: float) -> DataFrame:
    """The state one step on. A step that leaves the bracket or is too long halves it, or widens it where it is open."""
    rows = state.join(moments, _same("source", "m_source"), "left")
    want = F.col("target") / F.col("scale")
    rows = rows.withColumn("g", F.col("m1") - want).withColumn("done", F.col("m1").isNull() | (F.abs(F.col("m1") - want) <= tolerance * want))
    rows = rows.withColumn("high", F.when(~F.col("done") & (F.col("g") > 0), F.col("b")).otherwise(F.col("high")))
    rows = rows.withColumn("low", F.when(~F.col("done") & (F.col("g") <= 0), F.col("b")).otherwise(F.col("low")))
    newton = F.when(F.col("m2") > 0, F.col("b") - F.col("g") / F.col("m2"))
    longest = 4 * F.greatest(F.lit(1.0), F.abs("b"))
    good = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("b")) <= longest)
    closed = (F.col("low") > -math.inf) & (F.col("high") < math.inf)
    other = F.when(closed, (F.col("low") + F.col("high")) / 2).otherwise(F.col("b") - F.signum("g") * longest)
    step = F.when(F.col("done"), F.col("b")).when(good, newton).otherwise(other)
    live = F.col("live") & ~F.col("done") & (F.col("step") != F.col("b"))
    rows = rows.withColumn("step", step)
    return rows.select("source", "target", "scale", "full", live.alias("live"), F.col("step").alias("b"), "low", "high")


def class_copies(histogram: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """source, size, n, source_size, target, k: how many copies each size class gets."""
    tilted = tilt(histogram, goals, cap)
    facts = goals.select(F.col("source").alias("g_source"), F.col("total").alias("source_size"), "target").join(tilted.withColumnRenamed("source", "t_source"), _same("g_source", "t_source")).drop("t_source")
    rows = histogram.join(facts, _same("source", "g_source")).drop("g_source")
    rate = F.when(F.col("full"), cap).otherwise(F.least(F.lit(cap), F.exp(F.least(F.lit(700.0), F.col("b") * F.col("size") / F.col("scale")))))
    by_size = Window.partitionBy("source").orderBy("size")  # a row for each size of a source
    upto = F.floor(F.sum("given").over(by_size.rowsBetween(Window.unboundedPreceding, 0)) + 0.5 + 1e-9)
    before = F.coalesce(F.lag("upto").over(by_size), F.lit(0))
    most = (cap * F.col("n")).cast("long")
    rows = rows.withColumn("given", F.col("n") * rate).withColumn("upto", upto).withColumn("k", F.greatest(F.lit(0), F.least(most, F.col("upto") - before)))
    classes = materialise(rows.select("source", "size", "n", "source_size", "target", F.col("k").cast("long").alias("k")), "classes")
    while True:
        choice = materialise(_nearer(classes, cap), "choice")
        if choice.isEmpty():
            return classes
        picked = classes.join(choice, _same("source", "c_source") & (F.col("size") == F.col("c_size")), "left")
        classes = materialise(picked.select("source", "size", "n", "source_size", "target", (F.col("k") + F.coalesce("step", F.lit(0))).alias("k")), "classes")


def _nearer(classes: DataFrame, cap: float) -> DataFrame:
    """c_source, c_size, step (1 or -1): the copy whose change brings each source nearest to its target, if any does."""
    gap = classes.groupBy(F.col("source").alias("g_source")).agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("gap"))
    rows = classes.join(gap, _same("source", "g_source"))
    more = F.col("gap") > 0
    can = F.when(more, F.col("k") + 1 <= cap * F.col("n")).otherwise(F.col("k") > 0)
    # By half a word at least: what is left can't be less than rounding to whole words leaves.
    left = F.abs(F.abs("gap") - F.col("size"))
    rows = rows.filter(can & (F.col("size") > 0) & (left + 0.5 <= F.abs("gap")))
    best = rows.groupBy("source", more.alias("more")).agg(F.min(F.struct(left.alias("left"), "size")).alias("best"))
    return best.select(F.col("source").alias("c_source"), F.col("best.size").alias("c_size"), F.when(F.col("more"), 1).otherwise(-1).cast("long").alias("step"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a row for each row of docs."""
    narrow = materialise(sizes(docs), "sizes")
    histogram = materialise(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("total"))
    classes = class_copies(histogram, materialise(targets(totals, weights, share, cap), "targets"), cap)
    # One key for a class, null sources included.
    key = F.concat(F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")), F.lit(" "), F.col("size").cast("string"))
    classes = classes.withColumn("key", key).drop("source", "size")
    many = int(common.HOT * narrow.count()) + 1
    parts = F.ceil(F.col("n") / many).cast("int")
    # Classes of more than a share HOT of all rows: 1 / HOT of them at most.
    hot = F.broadcast(classes.filter(F.col("n") > many).select(F.col("key").alias("hot_key"), parts.alias("parts")))
    dealt = narrow.withColumn("key", key).join(hot, F.col("key") == F.col("hot_key"), "left")
    dealt = dealt.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    # Ranks go on from place to place; cold classes have one. A hot class has `parts` rows here.
    counts = dealt.filter("hot_key is not null").groupBy("key", "place").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(F.col("key").alias("f_key"), F.col("place").alias("f_place"), before.alias("first"))
    table = classes.withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    table = table.join(first, (F.col("key") == F.col("f_key")) & (F.col("place") == F.col("f_place")), "left").drop("f_key", "f_place")
    order = Window.partitionBy("key", "place").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    ranked = dealt.select("doc_id", "source", "size", "key", "place").withColumn("rn", F.row_number().over(order))
    # Dealt by (key, place) already; the table grows with the sizes of documents, so it isn't to be broadcast.
    out = ranked.join(table.hint("merge"), ["key", "place"])
    rank = F.coalesce("first", F.lit(0)) + F.col("rn")
    n = (F.floor(F.col("k") / F.col("n")) + F.when(rank <= F.col("k") % F.col("n"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept.

    Rows of one id are told apart by source and size; those alike in these too are interchangeable and share the copies
    that the mix takes of them.
    """
    every = materialise(copies(docs, **options).select("doc_id", "source", "size", "copies"), "copies")
    by_id = every.groupBy(F.col("doc_id").alias("__mix_id")).agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_rows"))
    if by_id.filter("__mix_rows > 1").isEmpty():
        rows = docs.join(by_id.filter("__mix_copies > 0"), F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_id"))).withColumn("__mix_n", F.col("__mix_copies"))
    else:
        alike = every.groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"))
        alike = alike.agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_rows"))
        mine = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_id")) & F.col("source").cast("string").eqNullSafe(F.col("__mix_source")) & (mine == F.col("__mix_size"))
        keys = ["__mix_id", "__mix_source", "__mix_size"]
        rows = docs.join(alike, same)
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.col("text"))))
        each = F.floor(F.col("__mix_copies") / F.col("__mix_rows")) + F.when(rn <= F.col("__mix_copies") % F.col("__mix_rows"), 1).otherwise(0)
        rows = rows.withColumn("__mix_n", each.cast("long")).filter("__mix_n > 0")
    return rows.withColumn("__mix_one", F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))

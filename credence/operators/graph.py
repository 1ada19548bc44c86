"""Graph operators: components, ranks, closures, paths, component metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written into the folder that spark.checkpoint.dir names and read back: the plan starts anew there."""
    from credence.plans.session import tables_dir

    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id that each node reaches. nodes: id; edges: a, b.

    Each round all nodes take the smallest label around them, then the label of that label; the number of rounds grows
    with the logarithm of a component's diameter. Lineage is cut each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cut(both, "edges")
    labels = cut(nodes.select("id", F.col("id").alias("comp")).distinct(), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("low"))
        step = labels.join(around, F.col("id") == F.col("a"), "left").select("id", "comp", F.least("comp", F.coalesce("low", "comp")).alias("next"))
        jump = step.select(F.col("id").alias("j"), F.col("next").alias("jn"))
        new = cut(step.join(jump, F.col("next") == F.col("j"), "left").select("id", "comp", F.least("next", F.coalesce("jn", "next")).alias("next")), "labels")
        if new.filter("next <> comp").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", F.col("next").alias("comp"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.78, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """item_id, id, rank: personalised PageRank of each item's graph, min-max normalised, 1 for all where all are equal.

    nodes: item_id, id, weight (personalisation, at least 0.001); edges: item_id, from_id, to_id, weight. All items
    advance together; dangling mass goes back by personalisation; lineage is cut each round. For graphs too large for a
    task: `pagerank_by_item` does the same within one.
    """
    item = Window.partitionBy("item_id")
    p = F.greatest(F.lit(0.001), F.col("weight"))
    n = cut(nodes.select("item_id", "id", (p / F.sum(p).over(item)).alias("p")), "start")
    out = edges.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("item_id", "from_id"))).select("item_id", "from_id", "to_id", "share")
    out = cut(out, "shares")
    sources = out.select("item_id", F.col("from_id").alias("id")).distinct().withColumn("has", F.lit(True))
    n = cut(n.join(sources, ["item_id", "id"], "left").select("item_id", "id", "p", F.coalesce("has", F.lit(False)).alias("has")), "start")
    ranks = n.withColumn("rank", F.col("p"))
    for _ in range(rounds):
        flow = out.join(ranks.select("item_id", F.col("id").alias("from_id"), "rank"), ["item_id", "from_id"]).groupBy("item_id", F.col("to_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        lost = ranks.groupBy("item_id").agg(F.sum(F.when(~F.col("has"), F.col("rank")).otherwise(0.0)).alias("lost"))
        new = (1 - alpha) * F.col("p") + alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("p"))
        after = cut(ranks.join(flow, ["item_id", "id"], "left").join(lost, "item_id").select("item_id", "id", "p", "has", F.col("rank").alias("old"), new.alias("rank")), "ranks")
        ranks = after.drop("old")
        if after.groupBy("item_id").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).filter(F.col("d") >= tolerance).isEmpty():
            break
    from credence.operators.nodes import normalized

    return normalized(ranks, "rank", "item_id").select("item_id", "id", F.col("normalized").alias("rank"))


def pagerank_by_item(nodes: DataFrame, edges: DataFrame, alpha: float = 0.78) -> DataFrame:
    """As pagerank, an item's whole graph in one Arrow kernel: sessions are small and there are many of them."""
    import pandas as pd

    kind = dict(nodes.dtypes)

    def kernel(mine: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        from credence.operators.selection import _ranks

        ids = sorted(int(i) for i in mine["id"])
        if not ids:
            return pd.DataFrame({"item_id": [], "id": [], "rank": []})
        out: dict[int, dict[int, float]] = {}
        for (a, b), w in edges.groupby(["from_id", "to_id"])["weight"].sum().items():
            out.setdefault(int(a), {})[int(b)] = float(w)
        r = _ranks(ids, out, {int(i): float(w) for i, w in zip(mine["id"], mine["weight"])}, alpha)
        return pd.DataFrame({"item_id": [mine["item_id"].iloc[0]] * len(ids), "id": ids, "rank": [r[i] for i in ids]})

    both = nodes.select("item_id", "id", "weight").groupBy("item_id").cogroup(edges.select("item_id", "from_id", "to_id", "weight").groupBy("item_id"))
    return both.applyInPandas(kernel, f"item_id {kind['item_id']}, id {kind['id']}, rank double")


def support_closure(nodes: DataFrame, relations: DataFrame, depth: int = 5) -> DataFrame:
    """item_id, id, depth: what decisions reach along relations in at most `depth` steps, decisions left out."""
    starts = nodes.filter("node_type = 'decision'").select("item_id", "id")
    seen, front = starts.withColumn("depth", F.lit(0)), starts
    steps = relations.select("item_id", F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    for d in range(1, depth + 1):
        if d > 1:
            seen, front = cut(seen, "seen"), cut(front, "front")  # both are read twice a step
        front = front.join(steps, ["item_id", "id"]).select("item_id", F.col("next").alias("id")).distinct().join(seen, ["item_id", "id"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.join(starts, ["item_id", "id"], "left_anti").join(nodes.select("item_id", "id"), ["item_id", "id"], "left_semi")


def component_metrics(selected: DataFrame, relations: DataFrame) -> DataFrame:
    """item_id, largest_share, isolated_share, retained_share of a selection in its graph.

    retained: of the selected nodes with any relation, those that still have one within the selection.
    """
    from credence.operators.relations import induced

    key = lambda i, c: F.concat_ws(":", i, c)
    inside = induced(relations, selected)
    labels = components(selected.select(key("item_id", "id").alias("id")), inside.select(key("item_id", "from_id").alias("a"), key("item_id", "to_id").alias("b")))
    named = selected.withColumn("k", key("item_id", "id")).join(labels.select(F.col("id").alias("k"), "comp"), "k")
    size = named.groupBy("item_id", "comp").count().groupBy("item_id").agg(F.max("count").alias("largest"), F.sum("count").alias("n"))
    ends = lambda r: r.select("item_id", F.col("from_id").alias("id")).union(r.select("item_id", F.col("to_id").alias("id"))).distinct()
    flags = selected.select("item_id", "id").join(ends(inside).withColumn("inside", F.lit(True)), ["item_id", "id"], "left").join(ends(relations).withColumn("any", F.lit(True)), ["item_id", "id"], "left")
    shares = flags.groupBy("item_id").agg(F.avg(F.col("inside").isNull().cast("double")).alias("isolated_share"), F.coalesce(F.count_if("inside") / F.nullif(F.count_if("any"), F.lit(0)), F.lit(0.0)).alias("retained_share"))
    return size.join(shares, "item_id").select("item_id", (F.col("largest") / F.col("n")).alias("largest_share"), "isolated_share", "retained_share")


def path_to_root(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """session, leaf, id, depth: each leaf's chain of parents, itself first. A parent that isn't there ends it.

    entries: session, id, parent_id; leaves: session, id. Stretches of entries whose parents are the ones before them in order of
    ids are runs, each known by its first entry's parent. Between runs by pointer doubling: after k rounds all runs within 2^k
    steps are known, so a chain of any depth takes the logarithm of its runs in joins of runs, and entries are joined twice.
    An entry that is there repeatedly counts once, with all its parents. A cycle is an error.
    """
    rows = cut(_runs(entries), "runs")
    nodes = rows.filter("first").select("session", "id", "run", "at")
    attached = nodes.select("session", F.col("id").alias("parent_id"), F.col("run").alias("to"), F.col("at").alias("to_at"))
    # from a run's first entry to an entry of another run, so many steps up
    up = rows.filter("at = 0 and parent_id is not null").select("session", "run", "parent_id").join(attached, ["session", "parent_id"])
    up = cut(up.select("session", "run", "to", "to_at", F.lit(1).alias("steps")), "up")
    path = nodes.join(leaves.select("session", "id").distinct(), ["session", "id"]).select("session", F.col("id").alias("leaf"), "run", "at", F.lit(0).alias("depth"))
    path, step, most = cut(path, "path"), 1, None
    while True:
        more = path.join(up, ["session", "run"]).select("session", "leaf", F.col("to").alias("run"), F.col("to_at").alias("at"), (F.col("depth") + F.col("at") + F.col("steps")).alias("depth"))
        more = cut(more, "path")
        if more.isEmpty():
            break
        most = rows.count() if most is None else most
        if step > most:
            raise ValueError("a cycle of parents")
        path = path.unionByName(more)
        above = up.select("session", F.col("run").alias("to"), F.col("to").alias("above"), F.col("to_at").alias("above_at"), F.col("steps").alias("more"))
        up = up.join(above, ["session", "to"]).select("session", "run", F.col("above").alias("to"), F.col("above_at").alias("to_at"), (F.col("steps") + F.col("to_at") + F.col("more")).alias("steps"))
        up, step = cut(up, "up"), 2 * step
    ends = path.select("session", "leaf", "run", F.col("at").alias("end"), "depth")
    return nodes.join(ends, ["session", "run"]).filter("at <= end").select("session", "leaf", "id", (F.col("depth") + F.col("end") - F.col("at")).alias("depth"))


def _runs(entries: DataFrame) -> DataFrame:
    """session, id, parent_id, run, at (place in the run, from 0), first (false for what repeats an entry).

    Rows are dealt out by ranges of ids and a run ends with its range, so no task has to see a whole session.
    """
    rows = entries.select("session", "id", "parent_id").filter("session is not null and id is not null")
    rows = rows.repartitionByRange("session", "id").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("session", "part").orderBy("id")
    same = lambda c: F.coalesce(c == F.col("id"), F.lit(False))
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("id").over(w)).withColumn("two", F.lag("id", 2).over(w)).withColumn("after", F.lead("id").over(w))
    rows = rows.withColumn("first", ~same(F.col("before")))
    alone = F.col("first") & ~same(F.col("after")) & ~F.coalesce(F.col("two") == F.col("before"), F.lit(False))
    head = F.col("first") & ~(alone & F.coalesce(F.col("parent_id") == F.col("before"), F.lit(False)))
    rows = rows.withColumn("start", F.max(F.when(head, F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.when(F.col("first"), F.col("n") - F.col("start")).otherwise(0)
    return rows.select("session", "id", "parent_id", (F.shiftleft(F.col("part").cast("long"), 33) + F.col("start")).alias("run"), at.alias("at"), "first")


def context_entries(path: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of a path that are in context: the last compaction, what it kept, and all that follows.

    path: session, leaf, id, depth; entries: session, id, seq, type, first_kept (an id, for compactions).
    """
    rows = path.join(entries, ["session", "id"])
    last = rows.filter("type = 'compaction'").groupBy("session", "leaf").agg(F.max_by(F.struct("seq", "first_kept"), "seq").alias("c"))
    kept_at = entries.select("session", F.col("id").alias("first_kept"), F.col("seq").alias("kept_seq"))
    last = last.select("session", "leaf", F.col("c.seq").alias("cut"), F.col("c.first_kept").alias("first_kept")).join(kept_at, ["session", "first_kept"], "left")
    rows = rows.join(last, ["session", "leaf"], "left")
    keep = F.col("cut").isNull() | (F.col("seq") >= F.col("cut")) | (F.col("seq") >= F.col("kept_seq"))
    return rows.filter(keep).withColumn("order", F.when(F.col("seq") == F.col("cut"), F.lit(-1)).otherwise(F.col("seq"))).select("session", "leaf", "id", "order")

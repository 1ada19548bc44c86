"""Context selection under a budget.

Scores, similarities, strengths and costs are prepared as DataFrames; what is left is greedy and depends on its own
earlier choices. So nodes and relations of an item meet once, cogrouped, in an Arrow kernel that works on arrays: a
beam is a table of paths that grows by a column a step for all seeds at once, and what a choice changes (coverage,
neighbourhood, likeness) is kept as vectors over all candidates. Equal scores are settled by the smaller id, so results
never depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credence.functions import text as X
from credence.operators.nodes import adjustment, eligible

#: The weights of scores, the bends of costs, and how many of what. They must be these for equal results.
COST_SCALE, COST_POWER = 240.0, 0.34
FOCUSED_SEARCHES, FOCUSED_SEARCH_CHARS = 4, 650
RANK_START = {"query": 0.78, "recent": 0.22}
CONNECTED = {"query": 0.44, "rank": 0.27, "recent": 0.16, "confidence": 0.13}
NEWEST_RAW = {"query": 0.72, "confidence": 0.18, "score": 0.10}
NEAR_BONUS, SEED_TURNS, SEED_SIMILARITY, SEEDS, BEAM = 0.16, 2, 0.45, 12, 8
STEP = (0.35, 0.65)
FOCUSED = {"question": 0.24, "focus": 0.22, "query": 0.10, "best": 0.20, "mean": 0.09, "recent": 0.08, "confidence": 0.07}
BRANCH = {"gain": 0.62, "quality": 0.38, "mean": 0.48, "full": 0.22, "score": 0.20, "recent": 0.10, "scale": 900.0, "power": 0.28}
BRANCH_NODES, BRANCHES, FULL, LEAST_BEST = 8, 6, 0.8, 0.08
REST = {"gain": 0.24, "joined": 0.12, "alike": 0.16}
SEARCH = {"degree": 0.28, "strength": 0.22, "focus": 0.18, "question": 0.12, "recent": 0.12, "answers": 0.08}
OUT = "item_id string, strategy string, pos int, id long, cost long"
_OUT = pa.schema([("item_id", pa.string()), ("strategy", pa.string()), ("pos", pa.int32()), ("id", pa.int64()), ("cost", pa.int64())])


def prepared(nodes: DataFrame, similarity: DataFrame) -> DataFrame:
    """item_id, id, turn, confidence, cost, search, raw, newest_ok, adjust, and a column for each similarity family.

    similarity: item_id, id, query, similarity, where query names the family.
    """
    search = X.is_search(F.col("extraction_method"), F.col("query"))
    rows = eligible(nodes).select(
        "item_id", "id", F.coalesce("turn_id", F.lit(-1)).alias("turn"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), X.node_cost(F.col("id"), F.col("text"), F.col("confidence"), search).alias("cost"), search.alias("search"),
        F.coalesce(F.col("extraction_method") == "rule_tool_result", F.lit(False)).alias("raw"), (~F.col("text").contains("Search budget exhausted")).alias("live"), adjustment().alias("adjust"), "text",
    )
    wide = similarity.groupBy("item_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("query", "similarity"))).alias("sim"))
    return rows.join(wide, ["item_id", "id"], "left").withColumn("sim", F.coalesce("sim", F.create_map().cast("map<string,double>")))


def _worth(score, cost, scale: float = COST_SCALE, power: float = COST_POWER):
    """A score by its cost; numbers or arrays."""
    return score / (1 + cost / scale) ** power


# -- graphs as arrays --------------------------------------------------------------------------------------------------


class _Edges:
    """The out-edges of nodes 0..n-1 in one run: those of node k lie between bounds[k] and bounds[k + 1]."""

    def __init__(self, ids: list[int], out: dict[int, dict[int, float]]):
        place = {i: k for k, i in enumerate(ids)}
        rows = sorted((place[i], place[j], w) for i, to in out.items() for j, w in to.items())
        source, target, weight = zip(*rows) if rows else ((), (), ())
        self.n, self.source, self.target, self.weight = len(ids), np.array(source, np.int64), np.array(target, np.int64), np.array(weight, float)
        self.bounds = np.searchsorted(self.source, np.arange(self.n + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes, edge number) of all their out-edges."""
        many = self.bounds[nodes + 1] - self.bounds[nodes]
        which = np.repeat(np.arange(len(nodes)), many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return which, self.bounds[nodes][which] + within


def _ranks(ids: list[int], out: dict[int, dict[int, float]], start: dict[int, float], alpha: float = 0.78) -> dict[int, float]:
    """Personalised PageRank of a small graph, min-max normalised."""
    e = _Edges(ids, out)
    p = np.maximum(0.001, [start[i] for i in ids])
    p = rank = p / p.sum()
    whole = np.bincount(e.source, e.weight, e.n)
    share = e.weight / whole[e.source]
    dangling = ~np.isin(np.arange(e.n), e.source)
    for _ in range(100):
        flow = np.bincount(e.target, rank[e.source] * share, e.n)
        new = (1 - alpha + alpha * rank[dangling].sum()) * p + alpha * flow
        moved, rank = np.abs(new - rank).sum(), new
        if moved < 1e-8:
            break
    low, high = rank.min(), rank.max()
    return dict.fromkeys(ids, 1.0) if math.isclose(low, high) else dict(zip(ids, ((rank - low) / (high - low)).tolist()))


def _beam(ids: list[int], out: dict, seeds: list[int], score: dict, cost: dict, depth: int, step: tuple[float, float] = STEP, power: float = COST_POWER) -> list[tuple[float, float, tuple[int, ...]]]:
    """(worth, gain, path) of every path that a beam from each seed keeps, all seeds in step: a row a path, a column a node."""
    e, place = _Edges(ids, out), {i: k for k, i in enumerate(ids)}
    s, c = np.array([score[i] for i in ids], float), np.array([cost[i] for i in ids], float)
    paths = np.array([[place[i]] for i in seeds], np.int64).reshape(len(seeds), 1)
    owner, gain, spent = np.arange(len(seeds)), s[paths[:, 0]], c[paths[:, 0]]
    found = [(_worth(gain, spent, power=power), gain, paths)]
    for _ in range(depth):
        which, edge = e.of(paths[:, -1])
        to = e.target[edge]
        new = ~(paths[which] == to[:, None]).any(axis=1)  # no node twice
        which, edge, to = which[new], edge[new], to[new]
        if not len(to):
            break
        g, used = gain[which] + e.weight[edge] * (step[0] + step[1] * s[to]), spent[which] + c[to]
        worth, longer = _worth(g, used, power=power), np.column_stack([paths[which], to])
        order = np.lexsort((*longer.T[::-1], -worth, owner[which]))
        of = owner[which][order]
        kept = order[np.arange(len(of)) - np.searchsorted(of, of) < BEAM]
        owner, gain, spent, paths = owner[which][kept], g[kept], used[kept], longer[kept]
        found.append((worth[kept], gain, paths))
    return [(float(u), float(g), tuple(ids[k] for k in path)) for us, gs, table in found for u, g, path in zip(us, gs, table)]


def _paths(out: dict, seeds: list[int], score: dict, cost: dict, depth: int) -> list[tuple[float, tuple[int, ...]]]:
    """Paths from the seeds by beam search, the most worth first, then the longest."""
    found = _beam(sorted(score), out, seeds, score, cost, depth)
    return sorted(((u, path) for u, _, path in found), key=lambda x: (-x[0], -len(x[1]), x[1]))


def _levels(seed: int, ranked: dict[int, list[int]], depth: int, most: int = BRANCH_NODES) -> list[int]:
    """The first `most` facts around a seed, level by level; each fact's neighbours in their order."""
    order, level = {seed: None}, [seed]
    for _ in range(depth):
        level = [j for j in dict.fromkeys(chain.from_iterable(ranked.get(i, ()) for i in level)) if j not in order]
        order |= dict.fromkeys(level)
        if len(order) >= most or not level:
            break
    return list(order)[:most]


class _Choice:
    """What has been taken, within a budget and at most `raws` raw results."""

    def __init__(self, rows: dict[int, dict], budget: int, raws: int = 2):
        self.rows, self.budget, self.raws, self.taken, self.used, self.n_raw = rows, budget, raws, {}, 0, 0

    @property
    def ids(self) -> list[int]:
        return list(self.taken)

    def take(self, ids: Iterable[int], budget: int | None = None) -> bool:
        """Take all of the ids that are new, or none of them."""
        new = [i for i in ids if i not in self.taken]
        size, raw = sum(self.rows[i]["cost"] for i in new), sum(self.rows[i]["raw"] for i in new)
        if not new or self.n_raw + raw > self.raws and raw or self.used + size > (self.budget if budget is None else budget):
            return False
        self.taken |= dict.fromkeys(new)
        self.used, self.n_raw = self.used + size, self.n_raw + raw
        return True


def _recency(rows: dict[int, dict]) -> dict[int, float]:
    turns = {i: r["turn"] for i, r in rows.items()}
    low, high = min(turns.values()), max(turns.values())
    return {i: (t - low) / max(1, high - low) for i, t in turns.items()}


def _newest_raw(rows: dict[int, dict]) -> list[int]:
    last = max(r["turn"] for r in rows.values())
    return sorted(i for i, r in rows.items() if r["raw"] and r["live"] and r["turn"] == last)


def _weighted(weights: dict[str, float], **parts: dict[int, float]) -> dict[int, float]:
    return {i: sum(w * parts[name][i] for name, w in weights.items()) for i in next(iter(parts.values()))}


def _best_first(value: dict[int, float], ids: Iterable[int]) -> list[int]:
    return sorted(ids, key=lambda i: (-value[i], i))


# -- selectors ---------------------------------------------------------------------------------------------------------


def _connected(rows: dict[int, dict], out: dict, budget: int, depth: int) -> list[int]:
    """The newest raw result, paths by worth, then single nodes, those next to what was taken first."""
    ids = sorted(rows)
    parts = {"query": {i: rows[i]["sim"].get("query", 0.0) for i in ids}, "recent": _recency(rows), "confidence": {i: rows[i]["confidence"] for i in ids}}
    parts["rank"] = _ranks(ids, out, _weighted(RANK_START, **parts))
    mixed = _weighted(CONNECTED, **parts)
    parts["score"] = score = {i: max(0.001, mixed[i] + rows[i]["adjust"]) for i in ids}
    cost = {i: rows[i]["cost"] for i in ids}
    worth = {i: _worth(score[i], cost[i]) for i in ids}
    since = max(r["turn"] for r in rows.values()) - SEED_TURNS
    seeds = _best_first(worth, (i for i in ids if rows[i]["turn"] >= since or parts["query"][i] >= SEED_SIMILARITY))[:SEEDS]
    fresh = _best_first(_weighted(NEWEST_RAW, **parts), _newest_raw(rows))[:1]
    choice = _Choice(rows, budget)
    for group in chain([fresh], (path for _, path in _paths(out, seeds, score, cost, depth))):
        choice.take(group)
    ends = {(i, j) for i, to in out.items() for j in to}
    beside = {i for i, j in ends if j in choice.taken} | {j for i, j in ends if i in choice.taken}
    left = {i: _worth(score[i] + NEAR_BONUS * (i in beside), cost[i]) for i in ids if i not in choice.taken}
    for i in _best_first(left, left):
        choice.take([i])
    return choice.ids


class _Focus:
    """One item's facts as vectors: scores, how far each covers each constraint, and how alike they are."""

    def __init__(self, rows: dict[int, dict], constraints: list[str]):
        self.rows, self.ids = rows, sorted(i for i, r in rows.items() if not r["search"])
        self.place = {i: k for k, i in enumerate(self.ids)}
        of = lambda name: np.array([rows[i]["sim"].get(name, 0.0) for i in self.ids])
        self.raw_sims = np.array([of(c) for c in constraints]).reshape(len(constraints), len(self.ids))
        sims = np.maximum(0.0, self.raw_sims)
        self.covers = np.minimum(1.0, sims / np.maximum(LEAST_BEST, sims.max(axis=1, keepdims=True))).T  # facts x constraints
        self.m = max(1, len(constraints))
        recent = _recency(rows)
        self.recent = np.array([recent[i] for i in self.ids])
        self.cost = np.array([rows[i]["cost"] for i in self.ids], float)
        parts = {name: np.maximum(0.0, of(name)) for name in ("question", "focus", "query")} | {"recent": self.recent, "confidence": np.array([rows[i]["confidence"] for i in self.ids])}
        parts |= {"best": self.covers.max(axis=1, initial=0.0), "mean": self.covers.sum(axis=1) / self.m}
        self.score = np.maximum(0.001, sum(w * parts[name] for name, w in FOCUSED.items()) + np.array([rows[i]["adjust"] for i in self.ids]))
        words = [set(str(rows[i]["text"]).lower().split()) for i in self.ids]
        self.sizes, self.words, self.holders = np.array([len(w) for w in words], float), words, {}
        for k, w in enumerate(words):
            for x in w:
                self.holders.setdefault(x, []).append(k)

    def alike(self, k: int) -> np.ndarray:
        """The likeness of every fact to fact k, by the words they share."""
        shared = np.zeros(len(self.ids))
        for x in self.words[k]:
            shared[self.holders[x]] += 1
        return shared / np.sqrt(np.maximum(1.0, self.sizes * self.sizes[k]))

    def covered(self, places: list[int]) -> np.ndarray:
        return self.covers[places].max(axis=0) if places else np.zeros(self.covers.shape[1])


def _facts_between(edges: list[dict], focus: _Focus) -> dict[int, list[int]]:
    """For each fact its neighbours: contradictions first, then the strongest, weighed by what they score."""
    both: dict[int, list] = {}
    for e in edges:
        for i, j in ((e["from_id"], e["to_id"]), (e["to_id"], e["from_id"])):
            if i in focus.place and j in focus.place:
                both.setdefault(i, []).append((e["type"] != "contradicts", -e["strength"] * (STEP[0] + STEP[1] * focus.score[focus.place[j]]), j))
    return {i: [j for *_, j in sorted(found)] for i, found in both.items()}


def _branches(focus: _Focus, edges: list[dict], near: dict[int, list[int]], depth: int) -> list[list[int]]:
    """The surroundings of each seed, each set of facts once. Seeds: the best for each constraint, the best of all, contradictions."""
    by_score = np.lexsort((np.arange(len(focus.ids)), -focus.score))
    for_each = [np.lexsort((np.arange(len(focus.ids)), -focus.score, -sims))[:2] for sims in focus.raw_sims]
    seeds = [focus.ids[k] for k in np.concatenate([*for_each, by_score[:SEEDS]])]
    seeds += [e[end] for e in edges if e["type"] == "contradicts" for end in ("from_id", "to_id") if e[end] in focus.place]
    found: dict[frozenset, list[int]] = {}
    for i in dict.fromkeys(seeds):
        branch = _levels(i, near, depth)
        found.setdefault(frozenset(branch), branch)
    return list(found.values())


def _take_branches(focus: _Focus, branches: list[list[int]], choice: _Choice) -> None:
    """Branch by branch, each time the one whose facts that still fit cover the most for their cost."""
    w = BRANCH
    for _ in range(BRANCHES):
        held = [focus.place[i] for i in choice.taken]
        before, best = focus.covered(held), None
        for n, branch in enumerate(branches):
            new = [focus.place[i] for i in branch if i not in choice.taken and not (focus.rows[i]["raw"] and choice.n_raw >= choice.raws) and choice.used + focus.rows[i]["cost"] <= choice.budget]
            if new:
                after = np.maximum(before, focus.covered(new))
                gain = (after - before).sum() / focus.m
                quality = w["mean"] * after.sum() / focus.m + w["full"] * (after >= FULL).sum() / focus.m + w["score"] * focus.score[new].max() + w["recent"] * focus.recent[new].max()
                u = _worth(w["gain"] * gain + w["quality"] * quality, focus.cost[new].sum(), w["scale"], w["power"])
                if best is None or u > best[0]:
                    best = u, n
        if best is None:
            return
        root, *others = branches.pop(best[1])
        for i in [root, *sorted(others, key=lambda i: (-focus.score[focus.place[i]], i))]:
            choice.take([i])


def _take_rest(focus: _Focus, near: dict[int, list[int]], choice: _Choice) -> None:
    """Single facts by score, new coverage and neighbourhood, less what repeats those taken; each taken one moves all others."""
    n = len(focus.ids)
    left, joined, alike = np.ones(n, bool), np.zeros(n), np.zeros(n)

    def noted(i: int) -> None:
        joined[[focus.place[j] for j in near.get(i, ())]] = 1
        np.maximum(alike, focus.alike(focus.place[i]), out=alike)

    for i in choice.taken:
        left[focus.place[i]] = False
        noted(i)
    covered = focus.covered([focus.place[i] for i in choice.taken])
    while left.any():
        gain = np.maximum(0.0, focus.covers - covered).sum(axis=1) / focus.m
        value = _worth(focus.score + REST["gain"] * gain + REST["joined"] * joined - REST["alike"] * alike, focus.cost)
        k = int(np.where(left, value, -np.inf).argmax())  # of equals the smallest id
        left[k] = False
        if choice.take([focus.ids[k]]):
            covered = np.maximum(covered, focus.covers[k])
            noted(focus.ids[k])
        else:  # what costs as much or more fits no better
            left &= ~((focus.cost >= focus.cost[k]) & (focus.cost + choice.used > choice.budget))


def _searches_around(rows: dict[int, dict], edges: list[dict], kept: set[int]) -> dict[int, float]:
    """What the searches next to kept facts are worth as their provenance."""
    touched: dict[int, list] = {}
    for e in edges:
        for search, fact, answers in ((e["from_id"], e["to_id"], False), (e["to_id"], e["from_id"], True)):
            if rows[search]["search"] and fact in kept and not (answers and rows[e["from_id"]]["search"]):
                touched.setdefault(search, []).append((fact, e["strength"], answers))
    recent = _recency(rows)
    value = {}
    for i, found in touched.items():
        facts, strengths, answers = zip(*found)
        parts = {"degree": min(3, len(set(facts))) / 3, "strength": max(strengths), "recent": recent[i], "answers": any(answers)}
        parts |= {name: max(0.0, rows[i]["sim"].get(name, 0.0)) for name in ("focus", "question")}
        value[i] = sum(w * parts[name] for name, w in SEARCH.items())
    return value


def _focused(rows: dict[int, dict], edges: list[dict], constraints: list[str], budget: int, depth: int) -> list[int]:
    if all(r["search"] for r in rows.values()):
        return []
    focus = _Focus(rows, constraints)
    near = _facts_between(edges, focus)
    choice = _Choice(rows, max(0, budget - min(FOCUSED_SEARCH_CHARS, budget // 5)))
    fresh = [i for i in _newest_raw(rows) if i in focus.place]
    choice.take(sorted(fresh, key=lambda i: (-focus.score[focus.place[i]], i))[:1])
    _take_branches(focus, _branches(focus, edges, near, min(3, depth)), choice)
    _take_rest(focus, near, choice)
    value = _searches_around(rows, edges, set(choice.taken))
    chosen, used, chars = choice.ids, choice.used, 0
    for i in sorted(value, key=lambda i: (-value[i], -rows[i]["turn"], i)):
        cost = rows[i]["cost"]
        if len(chosen) - len(choice.taken) < FOCUSED_SEARCHES and chars + cost <= FOCUSED_SEARCH_CHARS and used + cost <= budget:
            chosen.append(i)
            used, chars = used + cost, chars + cost
    return chosen


def by_item(rows: DataFrame, edges: DataFrame, kernel: Callable[[dict[int, dict], list[dict]], tuple[str, list[int]]]) -> DataFrame:
    """OUT of a kernel that gets an item's rows by id and its edges between them, and gives a name and ids in order.

    Rows and edges are cogrouped, so an item's edges travel once, not with each of its rows.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r["id"]: r | {"sim": dict(r["sim"] or {}), "raw": bool(r["raw"]), "search": bool(r["search"])} for r in left.to_pylist()}
        if not found:
            return _OUT.empty_table()
        item = left.column("item_id")[0].as_py()
        links = sorted((e for e in right.to_pylist() if e["from_id"] in found and e["to_id"] in found), key=lambda e: (e["from_id"], e["to_id"], e["type"], e["strength"], e["id"]))
        name, ids = kernel(found, links)
        n = len(ids)
        return pa.Table.from_arrays([pa.array([item] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), pa.array([int(found[i]["cost"]) for i in ids], pa.int64())], schema=_OUT)

    strength = F.col("strength") if "strength" in edges.columns else F.lit(0.0)
    pieces = edges.select("item_id", "id", "from_id", "to_id", "type", strength.cast("double").alias("strength"))
    return rows.groupBy("item_id").cogroup(pieces.groupBy("item_id")).applyInArrow(run, OUT)


def select(nodes: DataFrame, relations: DataFrame, similarity: DataFrame, strategy: str = "focused", budget: int = 6600, depth: int = 4, keep_all_fit: bool = True) -> DataFrame:
    """item_id, strategy (all_fit where all nodes fit, if that is kept), pos, id, cost.

    relations: for "connected" item_id, id, from_id, to_id, type; for "focused" the coherent ones (strength). similarity families: query; for
    "focused" also focus, question and constraint names c1, c2...
    """

    def kernel(rows: dict[int, dict], edges: list[dict]) -> tuple[str, list[int]]:
        from credence.operators.relations import OTHER_WEIGHT, RETRIEVAL_WEIGHTS

        if keep_all_fit and sum(r["cost"] for r in rows.values()) <= budget:
            return "all_fit", sorted(rows)
        if strategy == "connected":
            out: dict[int, dict[int, float]] = {}
            for e in sorted(edges, key=lambda e: e["id"]):
                out.setdefault(e["from_id"], {})[e["to_id"]] = RETRIEVAL_WEIGHTS.get(e["type"], OTHER_WEIGHT)
            return strategy, _connected(rows, out, budget, depth)
        names = {k for r in rows.values() for k in r["sim"] if k.startswith("c") and k[1:].isdigit()}
        return strategy, _focused(rows, edges, sorted(names, key=lambda k: int(k[1:])), budget, depth)

    return by_item(prepared(nodes, similarity), relations, kernel)


def ranked(nodes: DataFrame, similarity: DataFrame, strategy: str, fact_budget: int = 4900, search_budget: int = 1700) -> DataFrame:
    """Selections by a score alone: legacy (confidence and how found), semantic, or with PageRank (family ppr).

    Facts and searches have budgets of their own.
    """
    from credence.operators.budget import greedy

    rows = prepared(nodes, similarity)
    span = F.greatest(F.lit(1), F.max("turn").over(_item()) - F.min("turn").over(_item()))
    rows = rows.withColumn("recency", (F.col("turn") - F.min("turn").over(_item())) / span)
    s = F.coalesce(F.col("sim")["query"], F.lit(0.0))
    p = F.coalesce(F.col("sim")["ppr"], F.lit(0.0))
    legacy = F.when(F.col("search"), F.col("turn").cast("double")).otherwise(F.col("confidence") * 1000 + F.when(F.col("raw"), -100).when(F.col("adjust") > 0, 100).otherwise(0))
    score = {"legacy": legacy, "semantic": 0.72 * s + 0.18 * F.col("confidence") + 0.10 * F.col("recency"), "ppr": 0.55 * p + 0.28 * s + 0.10 * F.col("confidence") + 0.07 * F.col("recency")}[strategy]
    kinds = rows.select("item_id", "id", F.when(F.col("search"), "search").otherwise("fact").alias("kind"), F.round(score, 9).alias("score"), F.col("turn").alias("turn_id"), "cost")
    return greedy(kinds, {"fact": fact_budget, "search": search_budget})


def _item():
    from pyspark.sql import Window

    return Window.partitionBy("item_id")

"""Selectors that replay studies compare, the order in which a selection is shown, and its rendered size.

All share one frame: an item's prepared nodes and its coherent relations go through one kernel, candidates are taken by
diminishing returns (`_diverse`), and equal values are settled by the smaller id. Weights are fixed values.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window, functions as F

from credence.functions import text as X
from credence.operators.selection import _beam, _Choice, _connected, _paths, _ranks, _recency, _worth, by_item, prepared

_VAGUE = re.compile(r"(?i)\b(?:requires? verification|needs? verification|is investigating|considers? the possibility|could be|may be|might be|exact .* unknown)\b")
_SPECIFIC = re.compile(r"\b\d+(?:[.,:/-]\d+)*\b|[\"“][^\"”]{2,}[\"”]|\b[A-Z][a-z]+(?:\s+[A-Z][A-Za-z.'-]+)+\b")


class _Item:
    """One item: rows by id, relations, and what the selectors ask of them."""

    def __init__(self, rows: dict[int, dict], edges: list[dict]):
        self.rows, self.edges, self.recent = rows, edges, _recency(rows)
        self.cost = {i: r["cost"] for i, r in rows.items()}
        self.facts = sorted(i for i, r in rows.items() if not r["search"])
        self.out: dict[int, dict[int, float]] = {}
        self.both: dict[int, dict[int, float]] = {}
        self.against: set[tuple[int, int]] = set()
        for e in edges:
            a, b, w = e["from_id"], e["to_id"], float(e["strength"])
            self.out.setdefault(a, {})[b] = w
            for x, y in ((a, b), (b, a)):
                self.both.setdefault(x, {})[y] = max(w, self.both.get(x, {}).get(y, 0.0))
                if e["type"] == "contradicts":
                    self.against.add((x, y))
        self.words = {i: set(str(r["text"]).lower().split()) for i, r in rows.items()}

    def sim(self, i: int, family: str) -> float:
        return self.rows[i]["sim"].get(family, 0.0)

    def alike(self, i: int, j: int) -> float:
        a, b = self.words[i], self.words[j]
        return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0

    def same(self, i: int, others) -> float:
        return max((self.alike(i, j) for j in others), default=0.0)

    def mixed(self, i: int, **weights: float) -> float:
        return sum(w * {"confidence": self.rows[i]["confidence"], "recent": self.recent[i]}.get(k, self.sim(i, k)) for k, w in weights.items())


def _diverse(item: _Item, pool: list[int], value, penalty: float, taken, take) -> None:
    """Take from the pool by value less what is alike to what was taken, per cost, until it is empty or `take` says stop."""
    left = set(pool)
    while left:
        i = min(left, key=lambda i: (-_worth(value(i) - penalty * item.same(i, taken), item.cost[i]), i))
        left.discard(i)
        if take(i) is False:
            return


def chains(item: _Item, budget: int, depth: int = 4) -> list[int]:
    """Paths by relevance, rank, recency and confidence, then what lies next to them; costs only fill the budget."""
    ids = sorted(item.rows)
    rank = _ranks(ids, item.out, {i: 0.78 * item.sim(i, "query") + 0.22 * item.recent[i] for i in ids})
    score = {i: 0.42 * item.sim(i, "query") + 0.30 * rank[i] + 0.18 * item.recent[i] + 0.10 * item.rows[i]["confidence"] for i in ids}
    last = max(r["turn"] for r in item.rows.values())
    seeds = sorted((i for i in ids if item.rows[i]["turn"] >= last - 2 or item.sim(i, "query") >= 0.45), key=lambda i: (-score[i], i))[:10]
    c = _Choice(item.rows, budget, raws=len(ids))
    for _, path in _paths(item.out, seeds, score, dict.fromkeys(ids, 1), depth):
        c.take(list(path))
    near = set(c.ids)
    for i in sorted(set(ids) - near, key=lambda i: (-score[i] - 0.18 * bool(set(item.both.get(i, ())) & near), i)):
        c.take([i])
    return c.ids


def evidence_first(item: _Item, budget: int, depth: int = 3) -> list[int]:
    """Facts seed the paths, diverse ones first; searches only join them, six at most."""
    ids = sorted(item.rows)
    start = {i: max(0.001, item.mixed(i, question=0.65, query=0.25, recent=0.10)) for i in ids}
    rank = _ranks(ids, item.out, start, 0.72)
    score = {i: max(0.001, item.mixed(i, question=0.42, query=0.28, recent=0.07, confidence=0.08) + 0.15 * rank[i] + item.rows[i]["adjust"] - 0.10 * item.rows[i]["search"]) for i in ids}
    seeds: list[int] = []
    _diverse(item, item.facts, score.get, 0.22, seeds, lambda i: seeds.append(i) or len(seeds) < 24)
    paths = _beam(ids, item.both, seeds, score, item.cost, depth, (0.25, 0.75), 0.40)
    found = [(g if len(path) == 1 else u, path) for u, g, path in paths]
    c, searches = _Choice(item.rows, budget), 0
    for _, path in sorted(found, key=lambda x: (-x[0], -len(x[1]), x[1])):
        more = sum(item.rows[i]["search"] for i in path if i not in c.taken)
        if any(not item.rows[i]["search"] for i in path) and searches + more <= 6 and c.take(list(path)):
            searches += more
    for i in seeds:
        c.take([i])
    return c.ids


def _parts(item: _Item, ids: set[int]) -> dict[int, int]:
    part: dict[int, int] = {}
    for i in sorted(ids):
        if i not in part:
            queue = [i]
            while queue:
                j = queue.pop()
                if j not in part:
                    part[j] = i
                    queue += [k for k in item.both.get(j, ()) if k in ids]
    return part


def pruned(item: _Item, budget: int, depth: int = 4) -> list[int]:
    """The connected selection without its searches, refilled with diverse facts, then the searches that join its parts."""
    base = _connected(item.rows, item.out, budget, depth)
    searches = [i for i in base if item.rows[i]["search"]]
    c = _Choice(item.rows, budget)
    c.take([i for i in base if not item.rows[i]["search"]])
    room = budget - min(900, sum(item.cost[i] for i in searches))
    value = lambda i: item.mixed(i, question=0.44, focus=0.28, query=0.12, confidence=0.10, recent=0.06) + item.rows[i]["adjust"]
    _diverse(item, [i for i in item.facts if i not in c.taken], value, 0.18, c.taken, lambda i: c.take([i], room) or True)
    ids, left, n = list(c.ids), set(searches), 0
    used = c.used
    latest = max(searches, key=lambda i: (item.rows[i]["turn"], -i), default=None)
    while left and n < 6:
        part = _parts(item, set(ids))

        def worth(i: int) -> tuple:
            around = [j for j in item.both.get(i, ()) if j in part]
            edge = max((item.both[i][j] for j in around), default=0.0)
            made = any(i in item.out.get(j, ()) for j in around)
            joined = min(2, len({part[j] for j in around})) / 2
            return item.mixed(i, focus=0.28, question=0.20, recent=0.08) + 0.24 * joined + 0.12 * edge + 0.08 * made, edge, item.rows[i]["turn"], -i

        best = max(left, key=worth)
        left.discard(best)
        if (worth(best)[1] > 0 or best == latest) and used + item.cost[best] <= budget:
            ids.append(best)
            used += item.cost[best]
            n += 1
    return ids


def answer_directed(item: _Item, budget: int, depth: int = 4) -> list[int]:
    """Candidates for the answer first: specific statements up, vague ones down; then up to four searches next to them."""

    def value(i: int) -> float:
        text = str(item.rows[i]["text"])
        plain = item.mixed(i, question=0.50, focus=0.29, query=0.07, confidence=0.06, recent=0.04) + item.rows[i]["adjust"]
        return plain + 0.14 * (item.rows[i].get("node_type") == "decision") + 0.055 * bool(_SPECIFIC.search(text)) - 0.12 * bool(_VAGUE.search(text))

    c = _Choice(item.rows, budget, raws=1)
    room = max(0, budget - min(700, max(0, budget // 7)))

    def joined(i: int) -> float:
        near = [j for j in c.taken if j in item.both.get(i, ())]
        return value(i) + max((0.13 * item.both[i][j] for j in near), default=0.0) + 0.08 * any((i, j) in item.against for j in near)

    _diverse(item, item.facts, joined, 0.17, c.taken, lambda i: c.take([i], room) or True)
    ids = sorted(c.ids, key=lambda i: (-value(i), -item.rows[i]["turn"], -i))
    searches = [i for i in item.rows if item.rows[i]["search"]]
    latest = max(searches, key=lambda i: (item.rows[i]["turn"], -i), default=None)
    edge = {i: max((w for j, w in item.both.get(i, {}).items() if j in c.taken), default=0.0) for i in searches}
    made = {i: any(i in item.out.get(j, ()) for j in c.taken) for i in searches}
    used, n = c.used, 0
    for i in sorted(searches, key=lambda i: (-(item.mixed(i, focus=0.34, question=0.18, recent=0.10) + 0.26 * edge[i] + 0.12 * made[i]), -edge[i], -item.rows[i]["turn"], i)):
        if n < 4 and (edge[i] > 0 or i == latest) and used + item.cost[i] <= budget:
            ids.append(i)
            used += item.cost[i]
            n += 1
    return ids


STRATEGIES = {"chains": chains, "evidence_first": evidence_first, "pruned": pruned, "answer_directed": answer_directed}
ALWAYS = ("chains", "answer_directed")  # these select even where all fits


def path_order(item: _Item, ids: list[int]) -> list[int]:
    """A selection in the order of its evidence paths: parts by how well their facts answer, facts before searches."""
    chosen = set(ids)
    direct = {i: item.mixed(i, question=0.46, focus=0.24, query=0.10, confidence=0.10, recent=0.05) + 0.05 * (item.rows[i]["adjust"] > 0.05) for i in chosen}
    spread = {i: 0.78 * direct[i] + 0.22 * max((direct[j] * w for j, w in item.both.get(i, {}).items() if j in chosen), default=0.0) for i in chosen}
    groups: dict[int, list[int]] = {}
    for i, p in _parts(item, chosen).items():
        groups.setdefault(p, []).append(i)

    def rank(group: list[int]) -> tuple:
        pool = [i for i in group if not item.rows[i]["search"]] or group
        top = sorted((item.sim(i, "question") for i in pool), reverse=True)[:3]
        best = lambda f: max(f(i) for i in pool)
        return 0.46 * top[0] + 0.24 * sum(top) / len(top) + 0.16 * best(lambda i: item.sim(i, "focus")) + 0.09 * best(spread.get) + 0.05 * best(lambda i: item.rows[i]["confidence"]), best(item.recent.get), -min(group)

    order = lambda i: (item.rows[i]["search"], -spread[i], 0 if item.rows[i]["search"] else -item.rows[i]["confidence"], -item.recent[i], -i)
    return [i for g in sorted(groups.values(), key=rank, reverse=True) for i in sorted(g, key=order)]


def select(nodes: DataFrame, coherent: DataFrame, similarity: DataFrame, strategy: str, budget: int = 6600, depth: int = 4, by_path: bool = False) -> DataFrame:
    """item_id, strategy, pos, id, cost of a replay selector; by_path: in the order of evidence paths."""
    kinds = nodes.select("item_id", "id", "node_type")
    rows = prepared(nodes, similarity).join(kinds, ["item_id", "id"])

    def kernel(found: dict[int, dict], edges: list[dict]) -> tuple[str, list[int]]:
        item = _Item(found, edges)
        fits = sum(item.cost.values()) <= budget and strategy not in ALWAYS
        ids = sorted(found) if fits else STRATEGIES[strategy](item, budget, depth)
        return strategy, path_order(item, ids) if by_path else ids

    return by_item(rows, coherent, kernel)


def rendered(nodes: DataFrame, selected: DataFrame, relations: DataFrame, most: int = 8000) -> DataFrame:
    """item_id, text, chars: a selection as a prompt sees it: facts, searches, and relations by id while they fit. Fixed wording.

    The relation that doesn't fit ends the list; that is a running sum, so no kernel.
    """
    from credence.operators.nodes import display_order
    from credence.operators.relations import induced

    chosen = nodes.join(selected.select("item_id", "id"), ["item_id", "id"], "left_semi")
    search = X.is_search(F.col("extraction_method"), F.col("query"))
    lines = display_order(chosen).select("item_id", "rank", search.alias("search"), X.node_line(F.col("id"), F.col("text"), F.col("confidence"), search).alias("line"))
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("rank", "line")))), lambda x: x["line"]), "\n")
    g = lines.groupBy("item_id").agg(listed(~F.col("search")).alias("facts"), listed(F.col("search")).alias("searches"))
    block = lambda title, c, first: F.when(F.col(c) != "", F.concat(F.lit(("" if first else "\n\n") + f"#### {title}\n"), F.col(c))).otherwise("")
    head = F.ltrim(F.concat(block("Candidate evidence", "facts", True), block("Search history", "searches", False)), F.lit("\n"))
    g = g.select("item_id", head.alias("body"))
    edge = F.format_string("- [B%d] %s [B%d]", "from_id", "type", "to_id")
    e = induced(relations, selected).select("item_id", "id", edge.alias("line")).join(g.select("item_id", F.length("body").alias("n")), "item_id")
    run = F.sum(F.length("line") + 1).over(Window.partitionBy("item_id").orderBy("id"))
    start = F.lit(len("### Earlier investigation memory") + 1 + len("\n\n#### Relation paths")) + F.col("n")
    kept = e.withColumn("end", run + start).filter(F.col("end") <= most).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("edges"))
    text = F.concat(F.lit("### Earlier investigation memory\n\n"), F.col("body"), F.when(F.col("edges").isNotNull(), F.concat(F.lit("\n\n#### Relation paths\n"), F.col("edges"))).otherwise(""))
    return g.join(kept, "item_id", "left").select("item_id", text.alias("text"), F.length(text).alias("chars"))

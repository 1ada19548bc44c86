"""The selectors' array kernels against plain searches on small graphs."""

import itertools
import math

import numpy as np
import pytest

from credence.operators import selection as S


def graph(seed, n=9, edges=16):
    rng = np.random.default_rng(seed)
    out: dict = {}
    for a, b in rng.integers(0, n, (edges, 2)).tolist():
        if a != b:
            out.setdefault(a, {})[b] = float(rng.uniform(0.2, 1))
    score = {i: float(x) for i, x in enumerate(rng.uniform(0.01, 1, n))}
    cost = {i: int(x) for i, x in enumerate(rng.integers(20, 400, n))}
    return list(range(n)), out, score, cost


@pytest.mark.parametrize("seed", range(6))
def test_a_wide_beam_finds_every_simple_path(seed, monkeypatch):
    ids, out, score, cost = graph(seed)
    monkeypatch.setattr(S, "BEAM", 10_000)
    got = {path: (u, g) for u, g, path in S._beam(ids, out, [0, 3, 5], score, cost, 3)}
    want = {}
    for n in range(1, 5):
        for path in itertools.permutations(ids, n):
            if path[0] in (0, 3, 5) and all(b in out.get(a, {}) for a, b in zip(path, path[1:])):
                g = score[path[0]] + sum(out[a][b] * (0.35 + 0.65 * score[b]) for a, b in zip(path, path[1:]))
                want[path] = g / (1 + sum(cost[i] for i in path) / 240) ** 0.34, g
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in want)


def test_a_narrow_beam_keeps_the_best_of_each_seed(monkeypatch):
    ids, out, score, cost = graph(11, 12, 60)
    monkeypatch.setattr(S, "BEAM", 2)
    found = S._beam(ids, out, [0, 1], score, cost, 2)
    for seed in (0, 1):
        steps = sorted((-(score[seed] + w * (0.35 + 0.65 * score[j])) / (1 + (cost[seed] + cost[j]) / 240) ** 0.34, (seed, j)) for j, w in out.get(seed, {}).items())[:2]
        assert [p for _, _, p in found if p[0] == seed and len(p) == 2] == [p for _, p in steps]
        assert len([p for _, _, p in found if p[0] == seed and len(p) == 3]) == 2


@pytest.mark.parametrize("seed", range(4))
def test_ranks_solve_their_equation(seed):
    ids, out, start, _ = graph(seed)
    n, alpha = len(ids), 0.78
    p = np.array([max(0.001, start[i]) for i in ids])
    p /= p.sum()
    walk = np.zeros((n, n))
    for i in ids:
        to = out.get(i)
        walk[:, i] = p if not to else [to.get(j, 0.0) / sum(to.values()) for j in ids]
    r = np.linalg.solve(np.eye(n) - alpha * walk, (1 - alpha) * p)
    got = S._ranks(ids, out, start, alpha)
    assert np.allclose([got[i] for i in ids], (r - r.min()) / (r.max() - r.min()), atol=1e-6)
    assert S._ranks([1, 2], {}, {1: 1.0, 2: 1.0}) == {1: 1.0, 2: 1.0}


def test_levels_are_distances():
    near = {0: [3, 1], 1: [0, 2], 2: [1, 5], 3: [0, 4], 4: [3], 5: [2]}
    assert S._levels(0, near, 3) == [0, 3, 1, 4, 2, 5] and S._levels(0, near, 1) == [0, 3, 1] and S._levels(0, near, 3, 4) == [0, 3, 1, 4]


def rows_of(seed, n=10):
    rng = np.random.default_rng(seed)
    words = "red blue green stone river cloud night tower".split()
    names = ("query", "question", "focus", "c1", "c2")
    return {
        i: {"id": i, "turn": int(rng.integers(2, 6)), "confidence": float(rng.uniform(0.3, 0.9)), "cost": int(rng.integers(60, 200)), "search": bool(i % 5 == 4), "raw": bool(i % 4 == 1), "live": True, "adjust": 0.0, "text": " ".join(rng.choice(words, 4)), "sim": {k: float(rng.uniform(0, 1)) for k in names}}
        for i in range(n)
    }


@pytest.mark.parametrize("seed", range(5))
def test_the_rest_is_taken_greedily(seed):
    """Each step's choice recomputed from scratch."""
    rows = rows_of(seed)
    focus = S._Focus(rows, ["c1", "c2"])
    near = {0: [2], 2: [0, 3], 3: [2]}
    choice = S._Choice(rows, 600)
    choice.take([0])
    S._take_rest(focus, near, choice)
    taken, used, raws, left = [0], rows[0]["cost"], int(rows[0]["raw"]), set(focus.ids) - {0}
    cover = lambda i: [min(1.0, rows[i]["sim"][c] / max(0.08, max(rows[j]["sim"][c] for j in focus.ids))) for c in ("c1", "c2")]
    alike = lambda i, j: len(set(rows[i]["text"].split()) & set(rows[j]["text"].split())) / math.sqrt(len(set(rows[i]["text"].split())) * len(set(rows[j]["text"].split())))
    while left:
        held = [max(c) for c in zip(*(cover(i) for i in taken))]
        value = lambda i: (focus.score[focus.place[i]] + 0.24 * sum(max(0, a - b) for a, b in zip(cover(i), held)) / 2 + 0.12 * any(i in near.get(j, ()) for j in taken) - 0.16 * max(alike(i, j) for j in taken)) / (1 + rows[i]["cost"] / 240) ** 0.34  # noqa: B023, E731
        i = max(left, key=lambda i: (round(value(i), 12), -i))
        left.discard(i)
        if used + rows[i]["cost"] <= 600 and not (rows[i]["raw"] and raws >= 2):
            taken.append(i)
            used, raws = used + rows[i]["cost"], raws + rows[i]["raw"]
    assert choice.ids == taken


@pytest.mark.parametrize("seed", range(5))
def test_selections_keep_to_their_budget(seed):
    rows = rows_of(seed, 14)
    edges = [{"from_id": a, "to_id": b, "type": t, "strength": 0.5, "id": k} for k, (a, b, t) in enumerate([(0, 1, "depends_on"), (4, 2, "supplements"), (3, 9, "contradicts"), (5, 6, "depends_on")])]
    for budget in (150, 500, 900):
        chosen = S._focused(rows, edges, ["c1", "c2"], budget, 4)
        assert len(set(chosen)) == len(chosen) and sum(rows[i]["cost"] for i in chosen) <= budget and sum(rows[i]["raw"] for i in chosen if not rows[i]["search"]) <= 2
        out: dict = {}
        for e in edges:
            out.setdefault(e["from_id"], {})[e["to_id"]] = 1.0
        connected = S._connected(rows, out, budget, 4)
        assert sum(rows[i]["cost"] for i in connected) <= budget and sum(rows[i]["raw"] for i in connected) <= 2


def test_nothing_but_searches():
    rows = {i: r | {"search": True} for i, r in rows_of(0).items()}
    assert S._focused(rows, [], ["c1"], 300, 4) == [] and S._connected(rows, {}, 300, 4)
    few = {i: r for i, r in rows_of(1).items() if i == 0}
    assert S._focused(few, [], [], 100_000, 4) == [0]

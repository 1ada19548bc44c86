"""Replay selectors: budgets, limits and orders on small random graphs."""

import random

import pytest

from credence.operators import replay as P


def item(seed):
    rng = random.Random(seed)
    rows = {}
    for i in range(30):
        search = rng.random() < 0.3
        rows[i] = {"turn": rng.randrange(2, 12), "confidence": rng.random(), "cost": rng.randrange(40, 160), "search": search, "raw": not search and rng.random() < 0.2, "live": True, "adjust": rng.choice([0.12, -0.06, 0.0]), "text": " ".join(rng.choice(["tea", "Bob", "42", "could be", "Ada Lovelace"]) for _ in range(4)), "node_type": "belief", "sim": {k: rng.random() for k in ("query", "focus", "question")}}
    edges = [{"id": k, "from_id": a, "to_id": b, "type": rng.choice(["depends_on", "contradicts"]), "strength": rng.random()} for k in range(50) for a, b in [(rng.randrange(30), rng.randrange(30))] if a != b]
    return P._Item(rows, edges)


@pytest.mark.parametrize("strategy", list(P.STRATEGIES))
@pytest.mark.parametrize("seed", range(6))
def test_selectors(strategy, seed):
    it = item(seed)
    for budget in (100, 900, 2000):
        ids = P.STRATEGIES[strategy](it, budget, 3)
        assert len(set(ids)) == len(ids) and sum(it.cost[i] for i in ids) <= budget
        searches = [i for i in ids if it.rows[i]["search"]]
        raws = [i for i in ids if it.rows[i]["raw"]]
        if strategy != "chains":
            assert len(searches) <= {"answer_directed": 4}.get(strategy, 6) and len(raws) <= {"answer_directed": 1}.get(strategy, 2)
        assert ids == P.STRATEGIES[strategy](item(seed), budget, 3)
        shown = P.path_order(it, ids)
        assert sorted(shown) == sorted(ids)

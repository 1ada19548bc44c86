import numpy as np

from credence.operators import sets, turns


def test_against_all_pairs(spark, monkeypatch):
    """Near copies, copies, empty texts and nulls, over several tiles, and no join on words."""
    monkeypatch.setattr(sets, "TILE", 16)
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        words = set(rng.choice(40, 12, replace=False).tolist()) if i % 3 == 0 or not rows else set(rows[-1][2]) ^ {int(rng.integers(40))}
        rows.append((f"t{i % 2}" if i % 4 else "t0", i, sorted(words)))
    data = [(t, i, " ".join(f"w{x}" for x in w)) for t, i, w in rows] + [("t0", 200, ""), ("t1", 201, None), (None, 202, "w1"), ("t0", 203, "w1 w2"), ("t0", 204, "w2 W1!")]
    cut = {i: (t, set((x or "").lower().replace("!", "").split())) for t, i, x in data}
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 72 * len(a | b)
    hits = [t for i, (t, a) in cut.items() if t and any(j < i and u == t and like(a, b) for j, (u, b) in cut.items())]
    df = spark.createDataFrame(data, "task string, seq long, query string")
    got = {r["task"]: r["repeated"] for r in turns.repeated_queries(df).collect()}
    assert got == {"t0": hits.count("t0"), "t1": hits.count("t1"), None: 0} and hits


def _alike(rows):
    """(block, seq) with an earlier alike set, by all pairs."""
    like = lambda a, b: 100 * len(a & b) >= 72 * len(a | b)
    return {(t, i) for t, i, a in rows if any(u == t and j < i and like(a, b) for u, j, b in rows)}


def test_sets_of_all_sizes(spark, monkeypatch):
    """Sets of one member to thousands, some just alike and some just not, in small tiles, strips and chunks, against all pairs."""
    for name, value in (("TILE", 300), ("TILE_SETS", 7), ("STRIP", 500), ("CHUNK", 64)):
        monkeypatch.setattr(sets, name, value)
    rng, rows = np.random.default_rng(1), []
    for size in (1, 2, 3, 5, 8, 13, 25, 50, 100, 200, 400, 3000):
        base = set(rng.choice(20000, size, replace=False).tolist())
        for share in (0, 0.04, 0.15, 0.16, 0.17, 0.3):
            k = round(share * size)
            rows.append(set(sorted(base)[k:]) | set(range(30000, 30000 + k)))
            rows.append(set(sorted(base)[: size - round(1.6 * k)]))
    order = rng.permutation(len(rows)).tolist()
    rows = [(f"t{i % 2}", order[i], x) for i, x in enumerate(rows) if x]
    df = spark.createDataFrame([(t, i, [f"w{w}" for w in x]) for t, i, x in rows], "block string, seq long, t array<string>")
    got = {(r["block"], r["seq"]) for r in sets.like_an_earlier_one(df, 0.72).collect()}
    assert got == _alike(rows) and 30 < len(got) < len(rows) - 20


def test_near_copies_are_not_paired_off(spark, monkeypatch):
    """Of near copies each is compared with the earliest, and texts that share frequent words only with none."""
    compared, alike = [], sets._alike
    monkeypatch.setattr(sets, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or alike(pairs, *rest))
    rng = np.random.default_rng(2)
    near = [set(range(200)) - set(rng.choice(200, 4, replace=False).tolist()) | {1000 + i} for i in range(300)]
    apart = [set(range(5000, 5060)) | set(range(10000 + 40 * i, 10040 + 40 * i)) for i in range(300)]
    rows = [("t", i, x) for i, x in enumerate(near + apart)]
    df = spark.createDataFrame([(t, i, [f"w{w}" for w in x]) for t, i, x in rows], "block string, seq long, t array<string>")
    got = {(r["block"], r["seq"]) for r in sets.like_an_earlier_one(df, 0.72).collect()}
    assert got == _alike(rows) == {("t", i) for i in range(1, 300)}
    assert sum(compared) < 10 * len(rows)

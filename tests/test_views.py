"""Public form, layered windows, raw dashboard records and entities, against plain Python; their queries against SQL."""

import glob
import json
import os
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.operators import dashboard, entities, layers, published
from credence.plans import catalog, views  # noqa: F401  views adds to the catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["public_nodes", "public_relations", "layered_windows", "dashboard_nodes", "dashboard_raw_edges", "merged_small_groups", "document_entities"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toArrow(), con.sql(catalog.ORACLE[name]).to_arrow_table()
    names = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in names))))
    assert names == sorted(want.column_names) and rows(got) == rows(want)


def test_public_form(spark):
    built = [
        ("a", 1, None, " x ", None, None, "user", None, 3, [9, 7, 8, 9, 5], None), ("a", 2, "decision", "", "go", "assistant", "user", "judged", None, None, 0.5),
        ("a", 3, "belief", " ", "kept back", "user", None, None, 1, [], 1.0), ("a", 4, None, None, None, None, None, None, None, None, None), ("a", 5, "odd", "y", None, "", "", "", 0, [7], 0.1), ("a", None, None, "z", None, None, None, None, None, None, None),
    ]
    schema = "item_id string, id long, node_type string, belief string, decision string, role string, source_role string, stance string, turn_id long, evidence_ids array<long>, confidence double"
    nodes = spark.createDataFrame(built, schema)
    evidence = spark.createDataFrame([("a", 7, "seven", None, 2), ("a", 8, "", "tool", 2), ("a", 9, "nine", "tool", None), ("b", 5, "other", None, 1)], "item_id string, id long, text string, role string, turn_id long")
    got = {r["id"]: r for r in published.nodes(nodes, evidence).collect()}
    assert set(got) == {1, 2, 5}
    assert [(e["id"], e["role"], e["trajectory_index"]) for e in got[1]["evidence"]] == [(9, "tool", -1), (7, "user", 2), (9, "tool", -1)]
    assert (got[1]["belief"], got[1]["layer"], got[1]["stance"], got[1]["confidence"]) == ("x", "io", "asserted", 1.0)
    assert (got[2]["node_type"], got[2]["belief"], got[2]["layer"], got[2]["trajectory_index"], got[2]["evidence"]) == ("decision", "go", "reasoning", -1, [])
    assert (got[5]["node_type"], got[5]["role"], got[5]["layer"], got[5]["evidence"][0]["role"]) == ("belief", "unknown", "reasoning", "unknown")
    ends = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 1, 3), ("b", 3, 1, 2)], "item_id string, id long, from_id long, to_id long")
    assert [r["id"] for r in published.relations(ends, published.nodes(nodes, evidence)).collect()] == [1]
    assert published.nodes(nodes.limit(0), evidence.limit(0)).count() == 0


def _windows(nodes, k, budget):
    """By hand: turn by turn, dropping the oldest line while the lines are too long."""
    out = {}
    for item in {n[0] for n in nodes}:
        turns = sorted({n[2] for n in nodes if n[0] == item})
        for at, turn in enumerate(turns):
            lines = []
            for _, i, t, text in (n for n in nodes if n[0] == item and 0 <= at - turns.index(n[2]) <= k):
                text = text or ""
                record = {"id": i, **({"layer": at - turns.index(t)} if t != turn else {}), "content": text[:220] + " …" if len(text) > 240 else text}
                lines.append((i, t == turn, json.dumps(record, ensure_ascii=False)))
            lines.sort()
            dropped = 0
            while lines and sum(len(x[2]) + 4 for x in lines) > budget:
                lines.pop(0)
                dropped += 1
            show = lambda new: "[\n" + ",\n".join("  " + x[2] for x in lines if x[1] == new) + "\n]"
            out[item, turn] = (show(False), show(True), [x[0] for x in lines], dropped)
    return out


@pytest.mark.parametrize("budget", [10, 60, 150, 400, 9000])
def test_layered_windows(spark, budget):
    texts = ["short", 'quotes " and \\ and /', "lines\nand\ttabs", "é" * 239, "ü" * 241, None, "", "😀 faces"]
    nodes = [(item, n * 3 % 23 + 1, n // 2 * 5, texts[(n + s) % len(texts)]) for s, item in enumerate("ab") for n in range(16)]
    got = layers.rendered(layers.turn_windows(spark.createDataFrame(nodes, "item_id string, id long, turn_id long, text string"), 2), budget).collect()
    assert {(r["item_id"], r["turn_id"]): (r["previous"], r["current"], r["retained"], r["omitted"]) for r in got} == _windows(nodes, 2, budget)


def test_raw_records_of_odd_shapes(spark):
    raw = [("g", 0, '{"payload": "text", "metadata": [1]}'), ("g", 1, "no json"), ("g", 2, None), ("g", 3, '{"id": 5, "type": "belief-variable", "posterior": "NaN", "confidence": 0.5, "source_type": " Tool  Call "}'), ("g", 4, '{"uuid": "u", "name": "n", "layer": "", "payload": {"type": "FACTOR", "belief": "b"}}')]
    got = {r["pos"]: r for r in dashboard.nodes(spark.createDataFrame(raw, "graph string, pos long, json string")).collect()}
    assert [got[i]["id"] for i in range(5)] == ["node_0", "node_1", "node_2", "5", "u"]
    assert [got[i]["type"] for i in range(5)] == ["Claim", "Claim", "Claim", "BeliefVariable", "Factor"]
    assert got[3]["posterior"] is None and got[3]["source_type"] == "tool_call" and got[0]["posterior"] is None
    assert (got[4]["label"], got[4]["layer"], got[4]["belief_text"], got[4]["x"]) == ("n", "Factor", "b", 0.0)
    edges = [("g", 0, '{"from_id": 1, "to_id": 2, "type": "Refutes"}'), ("g", 1, '{"source": "1", "target": "2", "label": "contradiction"}'), ("g", 2, '{"source": "1", "target": "2"}'), ("h", 0, '{"source": "1", "target": "2", "payload": {"relation": "against", "weight": "x"}}')]
    got = {(r["graph"], r["pos"]): (r["id"], r["type"], r["direction"]) for r in dashboard.edges(spark.createDataFrame(edges, "graph string, pos long, json string")).collect()}
    assert got == {("g", 0): ("edge_0", "contradicts", 1 - 2), ("g", 2): ("edge_2", "informs", 1), ("h", 0): ("edge_0", "informs", -1)}


def test_entities(spark):
    texts = [(1, "Ada Lovelace met Ada at 12 The Ada lovelace"), (2, "   "), (3, None), (4, "nothing here"), (5, "broken Ada xx")]
    df = spark.createDataFrame(texts, "text_id long, text string")
    pairs, words, low = (entities.by_patterns([p]) for p in (("[A-Z][a-z]+ [A-Z][a-z]+", "Name", 0.9), (r"[A-Z][a-z]+|\d+", "word", 0.6), ("x+", "x", 0.8)))
    fails = lambda f: lambda t: f(F.when(~t.contains("broken"), t))
    got = {r["text_id"]: [(e["start"], e["surface"], e["label"]) for e in r["entities"]] for r in entities.extracted(df, [fails(pairs), fails(words)], [fails(pairs), low]).collect()}
    # The numbers and the article name nothing; "The Ada" is surer than "Ada"; where all methods fail the second fallback answers.
    assert got == {1: [(0, "Ada Lovelace", "Name"), (17, "Ada", "word"), (27, "The Ada", "Name")], 2: [], 3: [], 4: [], 5: [(11, "xx", "x")]}
    few = entities.extracted(df, [pairs, words], least=0.7, labels=["NAME"]).collect()
    assert sum(len(r["entities"]) for r in few) == 2
    free = entities.extracted(df, [pairs, words], merge=False).collect()
    assert {r["text_id"]: len(r["entities"]) for r in free}[1] == len({(m.lower()) for m in re.findall("[A-Z][a-z]+", texts[0][1])} - {"the"}) + 2
    assert entities.extracted(df, [], [low]).count() == 5 and entities.extracted(df.limit(0), [pairs]).count() == 0


def test_entities_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(entities, "PIECE", 50)
    texts = ["Ada Eve " * 10, None, "", "x", "Bob " * 120] * 40
    found = entities.by_patterns([("[A-Z][a-z]+", "Word", 0.7), ("[a-z]", "low", 0.1)])
    whole = [None if t is None else [(m.start(), m.end(), k) for p, k in (("[A-Z][a-z]+", "Word"), ("[a-z]", "low")) for m in re.finditer(p, t)] for t in texts]
    pieces = list(found.func(iter([pa.array(texts[:7]), pa.array([], pa.string()), pa.array(texts[7:])])))
    assert [None if x is None else [(s["start"], s["end"], s["label"]) for s in x] for p in pieces for x in p.to_pylist()] == whole
    assert max(len(p.flatten()) for p in pieces) < 50 + 360 and len(pieces) > 40  # a text's spans stay together
    pieces = list(entities._in_pieces([{"start": 0, "end": 1, "surface": "A", "label": "x", "confidence": 1.0}] * n for n in (20, 0, 40, 3, 0) * 9))
    assert [n for p in pieces for n in map(len, p.to_pylist())] == [20, 0, 40, 3, 0] * 9 and max(len(p.flatten()) for p in pieces) < 50 + 40
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(2)
    got = {r["text_id"]: [(e["start"], e["surface"]) for e in r["entities"]] for r in entities.extracted(df, [lambda t: found(F.when(t != "x", t))], [found], least=0.05).collect()}
    assert got == {i: {"A": [(0, "Ada"), (4, "Eve")], "B": [(0, "Bob")], "x": [(0, "x")]}.get((t or "")[:1], []) for i, t in enumerate(texts)}

"""Queries over the public form, windows of relation models, raw dashboard records, chunks and entities, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.operators import dashboard, entities, layers, published, retrieval as RT
from credence.plans import base as B
from credence.plans.catalog import _evidence, _nodes_with_evidence, query
from credence.plans.session import table

ND, RL = B.NODES_SQL, B.RELATIONS_SQL


# -- the public form ---------------------------------------------------------------------------------------------------


def _built(spark, sf):
    """Nodes of which some say only a decision, some nothing, some get their role from their source."""
    n = F.col("len")
    return _nodes_with_evidence(spark, sf).select(
        "item_id", "id", "node_type", F.when(n % 13 == 0, " ").when(n % 4 != 1, F.col("text")).otherwise("").alias("belief"), F.when((n % 4 == 1) & (n % 9 != 0), F.col("text")).alias("decision"),
        F.when(n % 3 != 0, F.col("role")).alias("role"), F.when(n % 6 != 0, F.col("role")).alias("source_role"), F.when(n % 5 != 0, F.col("stance")).alias("stance"), "turn_id", "evidence_ids", F.when(n % 2 == 0, F.col("confidence")).alias("confidence"),
    )


PUBLIC_SQL = """pub AS (SELECT item_id, id, node_type, trim(text, ' ') AS belief, CASE WHEN len % 5 <> 0 THEN stance ELSE 'asserted' END AS stance, CASE WHEN len % 6 <> 0 THEN role ELSE 'unknown' END AS role, turn_id AS trajectory_index, CASE WHEN len % 2 = 0 THEN confidence ELSE 1.0 END AS confidence, text
  FROM nodes WHERE len % 13 <> 0 AND NOT (len % 4 = 1 AND len % 9 = 0) AND trim(text, ' ') <> '')"""


@query(
    """SELECT item_id, id, node_type, md5(belief) AS belief, stance, role, CASE WHEN role IN ('user', 'tool', 'function') THEN 'io' ELSE 'reasoning' END AS layer, trajectory_index, confidence,
  to_json([id * 10, id * 10 + 1, id * 10 + 2])::VARCHAR AS evidence_ids, 3 * trajectory_index + 3 AS evidence_turns FROM pub""",
    ND, PUBLIC_SQL,
)
def public_nodes(spark, sf):
    """Constructed nodes in the public form, with layers and the evidence that is there."""
    rows = published.nodes(_built(spark, sf), _evidence(spark, sf))
    turns = F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a + e["trajectory_index"])
    return rows.select("item_id", "id", "node_type", F.md5("belief").alias("belief"), "stance", "role", "layer", "trajectory_index", "confidence", F.to_json(F.transform("evidence", lambda e: e["id"])).alias("evidence_ids"), turns.alias("evidence_turns"))


@query("SELECT r.item_id, r.id, r.from_id, r.to_id, r.type FROM relations r JOIN pub a ON a.id = r.from_id JOIN pub b ON b.id = r.to_id", ND, RL, PUBLIC_SQL)
def public_relations(spark, sf):
    """Relations between nodes that became public."""
    nodes = published.nodes(_built(spark, sf), _evidence(spark, sf))
    return published.relations(B.relations(spark, sf), nodes).select("item_id", "id", "from_id", "to_id", "type")


# -- windows of relation models ----------------------------------------------------------------------------------------


@query(
    """SELECT item_id, turn_id, md5('[' || chr(10) || coalesce(string_agg(line, ',' || chr(10) ORDER BY id) FILTER (fits AND d > 0), '') || chr(10) || ']') AS previous, md5('[' || chr(10) || coalesce(string_agg(line, ',' || chr(10) ORDER BY id) FILTER (fits AND d = 0), '') || chr(10) || ']') AS current,
  count(*) FILTER (fits) AS retained, count(*) FILTER (NOT fits) AS omitted FROM (SELECT *, sum(length(line) + 2) OVER (PARTITION BY item_id, turn_id ORDER BY id DESC) <= 700 AS fits FROM w1) GROUP BY item_id, turn_id""",
    ND, "y AS (SELECT item_id, id, turn_id, text, dense_rank() OVER (PARTITION BY item_id ORDER BY turn_id) AS l FROM nodes)", "z AS (SELECT DISTINCT item_id, turn_id, l FROM y)",
    "w0 AS (SELECT z.item_id, z.turn_id, y.id, z.l - y.l AS d, CASE WHEN length(text) > 240 THEN substr(text, 1, 220) || ' …' ELSE text END AS t FROM z JOIN y ON y.item_id = z.item_id AND y.l BETWEEN z.l - 3 AND z.l)",
    """w1 AS (SELECT *, '  {"id": ' || id || CASE WHEN d > 0 THEN ', "layer": ' || d ELSE '' END || ', "content": ' || to_json(t)::VARCHAR || '}' AS line FROM w0)""",
)
def layered_windows(spark, sf):
    """Each turn's new nodes and those of three turns before, as two lists under one budget."""
    rows = layers.rendered(layers.turn_windows(B.nodes(spark, sf), 3), 700)
    return rows.select("item_id", "turn_id", F.md5("previous").alias("previous"), F.md5("current").alias("current"), F.size("retained").cast("long").alias("retained"), "omitted")


# -- raw dashboard records ---------------------------------------------------------------------------------------------


def _raw_nodes(spark, sf):
    """Node records of four shapes."""
    n = B.nodes(spark, sf)
    s = F.struct
    shapes = (
        s("id", F.col("node_type").alias("type"), F.col("role").alias("label"), F.col("confidence").alias("posterior"), F.lit("Tool result").alias("source_type"), "stance", F.lit("io").alias("layer"), F.col("text").alias("belief"), s(F.col("turn_id").alias("trajectory_index"), F.lit(1.5).alias("x")).alias("payload")),
        s(F.concat(F.lit("u"), F.col("id")).alias("uuid"), F.lit("Belief_Variable").alias("node_type"), F.col("confidence").cast("string").alias("confidence"), s(F.col("role").alias("name"), F.col("text").alias("claim"), F.lit("message").alias("source_type"), F.lit("reasoning").alias("layer")).alias("payload"), s("stance", F.col("turn_id").alias("trajectory_index")).alias("metadata")),
        s(s(F.lit("claim").alias("type"), F.lit("0.25").alias("posterior")).alias("payload"), s(F.lit("Evidence").alias("label"), F.lit("open").alias("status"), F.lit("Model-Reasoning").alias("source_type")).alias("metadata")),
        s(F.lit("").alias("id"), F.lit("no object").alias("metadata"), F.array(F.lit(1)).alias("payload"), F.col("text").alias("decision"), F.lit("x").alias("probability"), F.lit("decision").alias("type")),
    )
    k = F.col("id") % 4
    raw = F.when(k == 0, F.to_json(shapes[0])).when(k == 1, F.to_json(shapes[1])).when(k == 2, F.to_json(shapes[2])).otherwise(F.to_json(shapes[3]))
    return n.select(F.col("item_id").alias("graph"), F.col("turn_id").alias("pos"), raw.alias("json"))


@query(
    """SELECT item_id AS graph, turn_id AS pos, CASE k WHEN 0 THEN id::VARCHAR WHEN 1 THEN 'u' || id ELSE 'node_' || turn_id END AS id, CASE k WHEN 0 THEN CASE node_type WHEN 'decision' THEN 'Decision' ELSE 'BeliefVariable' END WHEN 1 THEN 'BeliefVariable' WHEN 2 THEN 'Claim' ELSE 'Decision' END AS type,
  CASE WHEN k < 2 THEN role ELSE 'node_' || turn_id END AS label, CASE k WHEN 0 THEN confidence WHEN 1 THEN confidence WHEN 2 THEN 0.25 END AS posterior, CASE WHEN k = 2 THEN 'open' ELSE '' END AS status, ['tool_result', 'user_input', 'llm_reasoning', 'assistant_other'][k + 1] AS source_type,
  CASE WHEN k < 2 THEN stance ELSE 'asserted' END AS stance, ['io', 'reasoning', 'Claim', 'Decision'][k + 1] AS layer, md5(CASE WHEN k = 2 THEN 'node_' || turn_id ELSE text END) AS belief_text, CASE WHEN k < 2 THEN CAST(turn_id AS DOUBLE) END AS trajectory_index, CASE WHEN k = 0 THEN 1.5 ELSE 0.0 END::DOUBLE AS x
FROM (SELECT *, id % 4 AS k FROM nodes)""",
    ND,
)
def dashboard_nodes(spark, sf):
    """Raw records of four shapes as one kind of node."""
    return dashboard.nodes(_raw_nodes(spark, sf)).drop("y").withColumn("belief_text", F.md5("belief_text"))


@query(
    """SELECT item_id AS graph, CASE WHEN id % 2 = 0 THEN id::VARCHAR ELSE 'edge_' || id END AS id, from_id::VARCHAR AS source, to_id::VARCHAR AS target, CASE WHEN type = 'contradicts' THEN 'contradicts' WHEN id % 3 = 0 THEN 'confirms' ELSE 'informs' END AS type,
  CASE WHEN id % 2 = 1 AND id % 5 = 0 THEN 'backward' ELSE 'forward' END AS dir, weight, CASE WHEN type = 'contradicts' THEN -1 ELSE 1 END AS direction FROM relations""",
    ND, RL,
)
def dashboard_raw_edges(spark, sf):
    """Raw relations of two shapes, each twice, as directed edges without repeats."""
    i = F.col("id")
    kind = F.when(F.col("type") == "contradicts", "Contradicts").when(i % 3 == 0, "is supported").otherwise(F.col("type"))
    flat = F.struct(i.alias("id"), kind.alias("type"), "from_id", "to_id", "weight")
    nested = F.struct(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.struct(kind.alias("relation"), "weight", F.when(i % 5 == 0, "Backward").alias("_dir")).alias("payload"))
    raw = F.when(i % 2 == 0, F.to_json(flat)).otherwise(F.to_json(nested))
    rows = B.relations(spark, sf).select(F.col("item_id").alias("graph"), "id", raw.alias("json"))
    twice = rows.withColumn("pos", F.explode(F.array(i, i + 1000000000)))
    return dashboard.edges(twice.select("graph", "pos", "json")).drop("pos", "note")


# -- chunks ------------------------------------------------------------------------------------------------------------


@query(
    """SELECT text_id, index, CAST(len(list_filter(starts, lambda s: s <= pos)) - 1 AS BIGINT) AS "group" FROM c2 JOIN (SELECT text_id, arg_max(starts, step) AS starts FROM m GROUP BY text_id) USING (text_id)""",
    "recursive", "v AS (SELECT label AS text_id, vec_id AS index, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)", "v2 AS (SELECT *, lead(e) OVER (PARTITION BY text_id ORDER BY index) AS f FROM v)",
    "q AS (SELECT text_id, index, CASE WHEN f IS NOT NULL THEN 1 - list_sum(list_transform(list_zip(e, f), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(e, lambda y: y * y))) * sqrt(list_sum(list_transform(f, lambda y: y * y)))) END AS d FROM v2)",
    "c1 AS (SELECT q.*, d > t AS cut, row_number() OVER (PARTITION BY text_id ORDER BY index) AS pos FROM q JOIN (SELECT text_id, quantile_cont(d, 0.8) AS t FROM q GROUP BY text_id) USING (text_id))",
    "c2 AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY text_id ORDER BY index), true) AS opens FROM c1)",
    "st AS (SELECT text_id, list(pos ORDER BY pos) FILTER (opens) AS starts, list(d ORDER BY pos) AS gaps, count(*) AS n FROM c2 GROUP BY text_id)",
    """m AS (SELECT text_id, starts, gaps, n, 0 AS step FROM st UNION ALL SELECT text_id, list_filter(starts, lambda s: s <> gone), gaps, n, step + 1 FROM (
  SELECT *, CASE WHEN k = 1 THEN starts[2] WHEN k = len(starts) THEN starts[k] WHEN gaps[starts[k] - 1] <= gaps[starts[k + 1] - 1] THEN starts[k] ELSE starts[k + 1] END AS gone FROM (
    SELECT *, list_position(list_transform(starts, lambda s, i: coalesce(starts[i + 1], n + 1) - s < 4), true) AS k FROM m WHERE len(starts) > 1) WHERE k > 0))""",
)
def merged_small_groups(spark, sf):
    """Groups between breakpoints, those of under four merged over the nearer of their bounds."""
    w = table(spark, sf, "embeddings").select(F.col("label").alias("text_id"), F.col("vec_id").alias("index"), F.col("embedding").alias("vector"))
    return RT.without_small_groups(RT.breakpoints(w, 80.0), 4)


# -- entities ----------------------------------------------------------------------------------------------------------

NAMES = (("[A-Z][a-z]+ [A-Z][a-z]+", "NAME", 0.9), ("[A-Z][a-z]+", "Word", 0.7), ("[a-z]{4}", "SHORT", 0.4), ("[A-Z]", "OTHER", 1.0))
TERMS = (("[a-z]{9,}", "TERM", 0.6),)


def _spans_sql(name: str, pattern: str, label: str, confidence: float, where: str) -> str:
    """All matches with offsets, by the lengths of the pieces between them."""
    return f"""{name} AS (SELECT doc_id, CAST(sum(length(p)) OVER w + sum(length(s)) OVER w - length(s) AS BIGINT) AS a, s, '{label}' AS label, {confidence} AS c FROM (SELECT doc_id, unnest(f) AS s, unnest(g[:len(f)]) AS p, generate_subscripts(f, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, regexp_split_to_array(text, '{pattern}') AS g FROM documents WHERE trim(text) <> '' AND {where})) WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


@query(
    """SELECT d.doc_id, count(s) AS n, md5(coalesce(string_agg(a || ':' || s || ':' || label, ',' ORDER BY a), '')) AS entities FROM documents d LEFT JOIN once USING (doc_id) GROUP BY d.doc_id""",
    _spans_sql("nm", *NAMES[0], "n_chars % 3 <> 0"), _spans_sql("wd", *NAMES[1], "n_chars % 3 <> 0"), _spans_sql("tm", *TERMS[0], "n_chars % 3 = 0 AND n_chars % 2 = 0"),
    "al AS (SELECT * FROM nm UNION ALL SELECT * FROM wd WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.doc_id = wd.doc_id AND nm.a < wd.a + length(wd.s) AND wd.a < nm.a + length(nm.s)) UNION ALL SELECT * FROM tm)",
    "once AS (SELECT doc_id, a, s, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s), label ORDER BY a) AS r FROM al WHERE lower(s) NOT IN ('the', 'a', 'an', 'the user', 'the assistant', 'the tool', 'user', 'assistant', 'tool')) WHERE r = 1)",
)
def document_entities(spark, sf):
    """Names and words of whole documents; terms where that extractor fails, unless its fallback does as well."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text", F.col("n_chars").alias("n"))
    names, terms = entities.by_patterns(NAMES), entities.by_patterns(TERMS)
    rows = entities.extracted(d, [lambda t: names(F.when(F.col("n") % 3 != 0, t))], [lambda t: terms(F.when(F.col("n") % 2 == 0, t))], labels=["name", "word", "term"])
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["start"].cast("string"), e["surface"], e["label"])), ",")
    return rows.select(F.col("text_id").alias("doc_id"), F.size("entities").cast("long").alias("n"), F.md5(listed).alias("entities"))

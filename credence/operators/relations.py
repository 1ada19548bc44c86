"""Relations: validated, deduplicated, remapped, induced, ranked and adjoined to their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions import text as X
from credence.schema import RELATION_TYPES

#: Weight of a relation in retrieval, by type. Fixed values.
RETRIEVAL_WEIGHTS = {"depends_on": 1.0, "supplements": 0.82, "contradicts": 0.92}
OTHER_WEIGHT = 0.72


def _first_of(rows: DataFrame, *keys: str, order: str = "id") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def with_endpoints(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations both of whose ends are nodes of their item: two semi-joins."""
    ids = nodes.select("item_id", F.col("id").alias("__id"))
    a = relations.join(ids, (relations["item_id"] == ids["item_id"]) & (F.col("from_id") == F.col("__id")), "left_semi")
    return a.join(ids, (a["item_id"] == ids["item_id"]) & (F.col("to_id") == F.col("__id")), "left_semi")


def added(candidates: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that may be added: known types, both ends active, no loops, not there yet, each once."""
    ok = candidates.filter(F.col("type").isin(*RELATION_TYPES) & (F.col("from_id") != F.col("to_id")))
    ok = with_endpoints(ok, nodes.filter(F.coalesce("active", F.lit(True))) if "active" in nodes.columns else nodes)
    new = ok.join(existing.select("item_id", "from_id", "to_id", "type"), ["item_id", "from_id", "to_id", "type"], "left_anti")
    return _first_of(new, "item_id", "from_id", "to_id", "type")


def remapped(relations: DataFrame, mapping: DataFrame, directed: bool = False) -> DataFrame:
    """Ends sent through mapping (item_id, old_id, new_id); loops dropped, the first of each triple kept.

    directed: the public form, in which informs must point to a larger id, and confirms, contradicts, extends to a smaller.
    """
    m = lambda side: mapping.select("item_id", F.col("old_id").alias(side), F.col("new_id").alias(f"__{side}"))
    rows = relations.join(m("from_id"), ["item_id", "from_id"], "left").join(m("to_id"), ["item_id", "to_id"], "left")
    rows = rows.withColumn("from_id", F.coalesce("__from_id", "from_id")).withColumn("to_id", F.coalesce("__to_id", "to_id")).drop("__from_id", "__to_id").filter("from_id <> to_id")
    if directed:
        up, down = F.col("type") == "informs", F.col("type").isin("confirms", "contradicts", "extends")
        rows = rows.filter(F.when(up, F.col("from_id") < F.col("to_id")).when(down, F.col("from_id") > F.col("to_id")).otherwise(True))
    return _first_of(rows, "item_id", "from_id", "to_id", "type")


def remap_counts(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """item_id, n_in, n_loops, n_duplicates, n_out."""
    after = remapped(relations, mapping)
    m = lambda side: mapping.select("item_id", F.col("old_id").alias(side), F.col("new_id").alias(f"__{side}"))
    moved = relations.join(m("from_id"), ["item_id", "from_id"], "left").join(m("to_id"), ["item_id", "to_id"], "left")
    loop = F.coalesce("__from_id", "from_id") == F.coalesce("__to_id", "to_id")
    a = moved.groupBy("item_id").agg(F.count("*").alias("n_in"), F.count_if(loop).alias("n_loops"))
    out = a.join(after.groupBy("item_id").agg(F.count("*").alias("n_out")), "item_id", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    return out.select("item_id", "n_in", "n_loops", (F.col("n_in") - F.col("n_loops") - F.col("n_out")).alias("n_duplicates"), "n_out")


def resolved_window(proposals: DataFrame, nodes: DataFrame, allow_new_to_new: bool = True) -> DataFrame:
    """Proposals between new and previous nodes: at least one end new, known types, each once.

    nodes: item_id, id, is_new.
    """
    e = lambda side: nodes.select("item_id", F.col("id").alias(side), F.col("is_new").alias(f"{side}_new"))
    rows = proposals.join(e("from_id"), ["item_id", "from_id"]).join(e("to_id"), ["item_id", "to_id"])
    both = F.col("from_id_new") & F.col("to_id_new")
    rows = rows.filter((F.col("from_id_new") | F.col("to_id_new")) & (F.col("from_id") != F.col("to_id")) & F.col("type").isin(*RELATION_TYPES))
    return _first_of(rows if allow_new_to_new else rows.filter(~both), "item_id", "from_id", "to_id", "type").drop("from_id_new", "to_id_new")


def one_layer(resolved: DataFrame, layers: DataFrame) -> DataFrame:
    """Only relations to the layer that most of them use; of equals the nearest. layers: item_id, id, distance (0: new)."""
    d = lambda side: layers.select("item_id", F.col("id").alias(side), F.col("distance").alias(f"{side}_d"))
    rows = resolved.join(d("from_id"), ["item_id", "from_id"]).join(d("to_id"), ["item_id", "to_id"]).withColumn("layer", F.greatest("from_id_d", "to_id_d")).drop("from_id_d", "to_id_d")
    n = rows.filter("layer > 0").groupBy("item_id", "layer").count()
    best = n.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("count"), "layer"))).filter("rn = 1").select("item_id", F.col("layer").alias("best"))
    return rows.join(best, "item_id", "left").filter((F.col("layer") == 0) | (F.col("layer") == F.col("best"))).drop("best")


def viewer(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Older type names made new ones, loops and dangling ends dropped, each (from, to, type, id) once."""
    kind = F.when(F.col("type") == "informs", "depends_on").when(F.col("type") == "extends", "supplements").when(F.col("type") == "confirms", "supports").otherwise(F.col("type"))
    return with_endpoints(relations.withColumn("type", kind).filter("from_id <> to_id"), nodes).dropDuplicates(["item_id", "from_id", "to_id", "type", "id"])


def dashboard_type(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.contains("contradict") | low.contains("refute"), "contradicts").when(low.contains("confirm") | low.contains("support"), "confirms").when(low.contains("extend"), "extends").otherwise("informs")


def dashboard(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends, one for each source, target and type."""
    return _first_of(with_endpoints(relations.withColumn("type", dashboard_type(F.col("type"))), nodes), "item_id", "from_id", "to_id", "type")


def induced(relations: DataFrame, selected: DataFrame) -> DataFrame:
    return with_endpoints(relations, selected)


def role(kind: Column, weight: Column, from_search: Column, to_search: Column) -> Column:
    """0 contradictions, 1 between facts, 2 with a search and a weight, 3 provenance."""
    return F.when(kind == "contradicts", 0).when(~from_search & ~to_search, 1).when(weight.isNull() | (weight != 0), 2).otherwise(3)


def coherent(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The strongest relation of each pair of ends: type weight, raised by how alike the ends are, lowered by searches.

    nodes: item_id, id, text, turn_id, extraction_method, query. Contradictions between unlike ends (under 0.28) are noise.
    """
    search = X.is_search(F.col("extraction_method"), F.col("query"))
    e = lambda s: nodes.select("item_id", F.col("id").alias(f"{s}_id"), X.tokens(F.trim("text")).alias(f"{s}_tokens"), search.alias(f"{s}_search"), F.col("turn_id").alias(f"{s}_turn"))
    rows = relations.join(e("from"), ["item_id", "from_id"]).join(e("to"), ["item_id", "to_id"])
    rows = rows.withColumn("coherence", X.set_cosine(F.col("from_tokens"), F.col("to_tokens"))).drop("from_tokens", "to_tokens").filter("type <> 'contradicts' or coherence >= 0.28")
    base = F.lit(None)
    base = F.when(F.col("type") == "depends_on", RETRIEVAL_WEIGHTS["depends_on"]).when(F.col("type") == "supplements", RETRIEVAL_WEIGHTS["supplements"]).when(F.col("type") == "contradicts", RETRIEVAL_WEIGHTS["contradicts"]).otherwise(OTHER_WEIGHT)
    rows = rows.withColumn("strength", base * (0.30 + 0.70 * F.col("coherence")) * F.when(F.col("from_search") | F.col("to_search"), 0.78).otherwise(1.0))
    best = F.row_number().over(Window.partitionBy("item_id", "from_id", "to_id").orderBy(F.desc("strength"), "id"))
    return rows.withColumn("__n", best).filter("__n = 1").drop("__n").withColumn("role", role(F.col("type"), F.col("weight"), F.col("from_search"), F.col("to_search")))


def fact_adjacency(coherent_rows: DataFrame) -> DataFrame:
    """item_id, id, neighbour, strength, type: relations between facts, both ways."""
    facts = coherent_rows.filter("not from_search and not to_search")
    one = lambda a, b: facts.select("item_id", F.col(a).alias("id"), F.col(b).alias("neighbour"), "strength", "type")
    return one("from_id", "to_id").unionByName(one("to_id", "from_id"))


def top_selected(coherent_rows: DataFrame, selected: DataFrame, most: int = 24) -> DataFrame:
    """The relations shown with a selection: by role, strength, newest end, id; one provenance relation for each search."""
    rows = induced(coherent_rows, selected).withColumn("search_id", F.when(F.col("from_search"), F.col("from_id")).otherwise(F.col("to_id"))).withColumn("newest", F.greatest("from_turn", "to_turn"))
    order = [F.col("role"), F.desc("strength"), F.desc("newest"), F.col("id")]
    per = F.row_number().over(Window.partitionBy("item_id", "search_id", "role").orderBy(*order))
    rows = rows.withColumn("__p", per).filter("role <> 3 or __p = 1").drop("__p")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= most)


def render_checks(selection: DataFrame, nodes: DataFrame, relation_ids: DataFrame, relations: DataFrame) -> DataFrame:
    """Problems of a selection: code, item_id, id. Empty if it can be rendered."""
    missing = selection.join(nodes.select("item_id", "id"), ["item_id", "id"], "left_anti").select(F.lit("unknown_node").alias("code"), "item_id", "id")
    unknown = relation_ids.join(relations.select("item_id", "id"), ["item_id", "id"], "left_anti").select(F.lit("unknown_relation").alias("code"), "item_id", "id")
    chosen = relations.join(relation_ids, ["item_id", "id"], "left_semi")
    loose = chosen.join(induced(chosen, selection).select("item_id", "id"), ["item_id", "id"], "left_anti").select(F.lit("dangling_relation").alias("code"), "item_id", "id")
    return missing.unionByName(unknown).unionByName(loose)


def edge_window(relations: DataFrame, most: int = 400) -> DataFrame:
    """The last relations by (from, to), shown in that order: item_id, rank, line."""
    n = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("from_id"), F.desc("to_id"), F.desc("id")))
    rows = relations.withColumn("__n", n).filter(F.col("__n") <= most)
    line = F.format_string("[%d] -%s-> [%d]", "from_id", "type", "to_id")
    return rows.select("item_id", F.row_number().over(Window.partitionBy("item_id").orderBy("from_id", "to_id", "id")).alias("rank"), line.alias("line"))


def upserted(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Payloads replaced where the id is known, rows added where not; the identity of a known row stays."""
    n = nodes.select("item_id", "id", *(F.col(c).alias(f"__{c}") for c in nodes.columns if c not in ("item_id", "id")), F.lit(True).alias("__old"))
    u = updates.withColumn("__new", F.lit(True))
    rows = n.join(u, ["item_id", "id"], "full")
    cols = [F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in updates.columns and c != "uuid" else F.col(f"__{c}").alias(c) for c in nodes.columns if c not in ("item_id", "id")]
    return rows.select("item_id", "id", *cols)


def without_nodes(nodes: DataFrame, relations: DataFrame, gone: DataFrame, drop_edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and, unless told otherwise, the relations that touch them, deleted: anti-joins."""
    kept = nodes.join(gone, ["item_id", "id"], "left_anti")
    if not drop_edges:
        return kept, relations
    for side in ("from_id", "to_id"):
        relations = relations.join(gone.select("item_id", F.col("id").alias(side)), ["item_id", side], "left_anti")
    return kept, relations

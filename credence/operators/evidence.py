"""Evidence: looked up, deduplicated, made independent, summed and pruned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from credence.functions import text as X
from credence.functions.excerpts import excerpt_place


def of_nodes(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id, node_id, pos and the evidence a node names, in its order; unknown ids are passed over."""
    refs = nodes.select("item_id", F.col("id").alias("node_id"), F.posexplode("evidence_ids").alias("pos", "id"))
    return refs.join(evidence, ["item_id", "id"])


def listed(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id, node_id, evidence: an array in the node's order."""
    return of_nodes(nodes, evidence).groupBy("item_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("evidence"))


def for_viewer(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id, node_id, id: embedded evidence first, then what is referred to, each id once. nodes: evidence (array of structs with id), evidence_ids."""
    embedded = nodes.select("item_id", F.col("id").alias("node_id"), F.posexplode("evidence").alias("pos", "e")).select("item_id", "node_id", F.col("pos").alias("pos"), F.col("e.id").alias("id"), F.lit(0).alias("src"))
    named = of_nodes(nodes, evidence.select("item_id", "id")).select("item_id", "node_id", "pos", "id", F.lit(1).alias("src"))
    first = F.row_number().over(Window.partitionBy("item_id", "node_id", "id").orderBy("src", "pos"))
    return embedded.unionByName(named).withColumn("__n", first).filter("__n = 1").drop("__n")


def distinct(evidence: DataFrame) -> DataFrame:
    """The first record of each (turn, span, text, stance, role)."""
    n = F.row_number().over(Window.partitionBy("item_id", "turn_id", "start", "end", "text", "stance", "role").orderBy("id"))
    return evidence.withColumn("__n", n).filter("__n = 1").drop("__n")


def unreferenced(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that no active node names."""
    refs = nodes.filter(F.coalesce("active", F.lit(True))).select("item_id", F.explode("evidence_ids").alias("id"))
    return evidence.join(refs, ["item_id", "id"], "left_anti")


def pruned(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    refs = nodes.filter(F.coalesce("active", F.lit(True))).select("item_id", F.explode("evidence_ids").alias("id"))
    return evidence.join(refs, ["item_id", "id"], "left_semi")


def best_of_turn(scored: DataFrame) -> DataFrame:
    """One record of each (node, item, turn): the best score, then the smallest id. Records without a turn stand alone."""
    turn = F.coalesce(F.col("turn_id").cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))
    n = F.row_number().over(Window.partitionBy("item_id", "node_id", turn).orderBy(F.desc("score"), "id"))
    return scored.withColumn("__n", n).filter("__n = 1").drop("__n")


def independent(scored: DataFrame) -> DataFrame:
    """Records that corroborate independently: the best of each turn, then, best first, those that repeat neither the
    URLs nor the text of one taken before. That last step depends on order and runs in an Arrow kernel for each node.

    scored: item_id, node_id, id, turn_id, text, score.
    """
    rows = best_of_turn(scored).select("item_id", "node_id", "id", "score", X.canonical_urls(F.col("text")).alias("urls"), X.evidence_content(F.col("text")).alias("content"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        seen_urls, seen_text, keep = set(), set(), []
        for i, r in pdf.sort_values(["score", "id"], ascending=[False, True]).iterrows():
            urls = tuple(r["urls"])
            if (urls and urls in seen_urls) or (r["content"] and r["content"] in seen_text):
                continue
            seen_urls.add(urls)
            seen_text.add(r["content"])
            keep.append(i)
        return pdf.loc[sorted(keep), ["item_id", "node_id", "id", "score"]]

    kind = dict(scored.dtypes)
    return rows.groupBy("item_id", "node_id").applyInPandas(greedy, f"item_id {kind['item_id']}, node_id {kind['node_id']}, id {kind['id']}, score double")


def additional(nodes: DataFrame, evidence: DataFrame, hybrid: bool = False) -> DataFrame:
    """Evidence beyond that which created the node.

    Without `hybrid`: not of the node's own turn (of nodes without a turn, all but the first); with it: beyond the first
    initial_evidence_count.
    """
    own = nodes.select("item_id", F.col("id").alias("node_id"), F.col("turn_id").alias("own_turn"), F.coalesce("initial_evidence_count", F.lit(1)).alias("initial"))
    rows = of_nodes(nodes, evidence).join(own, ["item_id", "node_id"])
    keep = F.col("pos") >= F.col("initial") if hybrid else F.when(F.col("own_turn").isNull() | F.col("turn_id").isNull(), F.col("pos") > 0).otherwise(F.col("turn_id") != F.col("own_turn"))
    return rows.filter(keep).drop("own_turn", "initial")


def summed(scored: DataFrame) -> DataFrame:
    """item_id, node_id, evidence_confidence, evidence_ids: sums to six places and the ids that were scored."""
    return scored.groupBy("item_id", "node_id").agg(F.round(F.sum("score"), 6).alias("evidence_confidence"), F.array_sort(F.collect_list("id")).alias("evidence_ids"))


def recomputed(nodes: DataFrame, sums: DataFrame, step: str) -> DataFrame:
    """nodes with evidence_confidence and confidence anew, and a history row of the step."""
    from credence.functions.confidence import posterior

    s = sums.select("item_id", F.col("node_id").alias("id"), F.col("evidence_confidence").alias("__e"))
    rows = nodes.join(s, ["item_id", "id"], "left").withColumn("evidence_confidence", F.coalesce("__e", F.lit(0.0))).drop("__e")
    rows = rows.withColumn("__before", F.col("confidence")).withColumn("confidence", posterior(F.col("initial_confidence"), F.col("evidence_confidence"), F.col("factor_confidence")))
    entry = F.struct(F.lit(step).alias("step"), F.col("__before").alias("before"), F.col("confidence").alias("after"), F.col("evidence_confidence").alias("evidence"))
    return rows.withColumn("history", F.array(entry)).drop("__before")


def merge_record(step: str, canonical: DataFrame) -> DataFrame:
    """A history row of a merge: item_id, id, step, before, after, added, absorbed."""
    return canonical.select("item_id", "id", F.lit(step).alias("step"), F.lit("merge_evidence").alias("reason"), "before", "after", F.size("added_evidence_ids").alias("added"), F.array_sort("absorbed_ids").alias("absorbed"))


def from_excerpt(rows: DataFrame) -> DataFrame:
    """excerpt, content -> evidence with exact offsets and how it was found (exact, normalized, fuzzy, not_found)."""
    at = excerpt_place(F.col("excerpt"), F.col("content"))
    found = rows.withColumn("at", at)
    text = F.when(F.col("at.start").isNotNull(), F.substring("content", F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))).otherwise(F.trim("excerpt"))
    return found.select(*rows.columns, text.alias("text"), F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.col("at.match").alias("match"), F.lit("excerpt").alias("via"))


def from_sentences(rows: DataFrame) -> DataFrame:
    """A row for each sentence of content, an exact slice with its offsets."""
    return rows.withColumn("s", F.explode(X.split_sentences(F.col("content")))).select(*rows.columns, F.col("s.index").alias("index"), F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit("exact").alias("match"), F.lit("sentence").alias("via"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (content, start, end) clamped to the content and cut out."""
    n = F.length("content")
    a = F.greatest(F.lit(0), F.least(F.col("start"), n))
    b = F.greatest(a, F.least(F.col("end"), n))
    return chunks.withColumn("start", a).withColumn("end", b).withColumn("text", F.substring("content", F.col("start") + 1, F.col("end") - F.col("start"))).withColumn("match", F.lit("exact")).withColumn("via", F.lit("chunk"))


def marked_pieces(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts cut at all ends of marks, with the nodes that hold in each piece: text_id, start, end, piece, node_ids.

    texts: text_id, text; marks: text_id, start, end, node_id. Segments come from a sweep over sorted ends; each mark
    then spans a run of segment numbers, so the join is on equal numbers.
    """
    n = texts.select("text_id", F.length("text").alias("n"))
    m = marks.join(n, "text_id").select("text_id", F.greatest(F.lit(0), F.least("start", "n")).alias("start"), F.greatest(F.lit(0), F.least("end", "n")).alias("end"), "node_id").filter("end > start")
    ends = m.select("text_id", F.explode(F.array("start", "end")).alias("at")).unionByName(n.select("text_id", F.explode(F.array(F.lit(0), F.col("n"))).alias("at"))).distinct()
    w = Window.partitionBy("text_id").orderBy("at")
    numbered = ends.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("at").over(w))
    segments = numbered.filter("next is not null").select("text_id", "k", F.col("at").alias("start"), F.col("next").alias("end"))
    place = numbered.select("text_id", "at", "k")
    spans = m.join(place.select("text_id", F.col("at").alias("start"), F.col("k").alias("k0")), ["text_id", "start"]).join(place.select("text_id", F.col("at").alias("end"), F.col("k").alias("k1")), ["text_id", "end"])
    cover = spans.select("text_id", "node_id", F.explode(F.sequence("k0", F.col("k1") - 1)).alias("k")).groupBy("text_id", "k").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    rows = segments.join(cover, ["text_id", "k"], "left").join(texts, "text_id")
    return rows.select("text_id", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"), F.coalesce("node_ids", F.array().cast(cover.schema["node_ids"].dataType)).alias("node_ids"))


def entity_spans(spans: DataFrame) -> DataFrame:
    """Overlapping entity spans merged: by start, then longer, then surer; of two that overlap the surer, then longer stays.

    spans: text_id, start, end, label, confidence. Sequential, so an Arrow kernel for each text.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        rows = pdf.assign(n=pdf["end"] - pdf["start"]).sort_values(["start", "n", "confidence"], ascending=[True, False, False])
        for r in rows.itertuples(index=False):
            if out and r.start < out[-1].end:
                if (r.confidence, r.n) > (out[-1].confidence, out[-1].n):
                    out[-1] = r
            else:
                out.append(r)
        return pd.DataFrame([{c: getattr(r, c) for c in pdf.columns} for r in out], columns=list(pdf.columns))

    return spans.groupBy("text_id").applyInPandas(merge, spans.schema)


def entities_once(entities: DataFrame) -> DataFrame:
    """The first of each (text, label) of a text, case ignored, in text order."""
    n = F.row_number().over(Window.partitionBy("text_id", F.lower("surface"), "label").orderBy("start"))
    return entities.withColumn("__n", n).filter("__n = 1").drop("__n")

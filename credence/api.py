"""A facade over the tables: what an agent's memory is asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from credence.functions.confidence import Policy
from credence.operators import budget, evidence, graph, merge, nodes as N, propagation, relations as R, retrieval, selection


@dataclass(frozen=True)
class Memory:
    """nodes, evidence and relations of any number of items; every answer is a DataFrame, nothing runs before it is read."""

    nodes: DataFrame
    relations: DataFrame
    evidence: DataFrame | None = None

    def believe(self, target: str, most: int = 10) -> DataFrame:
        return N.believe(self.nodes, target, most)

    def context(self, focal: list[str], most: int = 100) -> DataFrame:
        return N.context(self.nodes, focal, most)

    def search(self, query: str, most: int = 10) -> DataFrame:
        return N.search(self.nodes, query, most)

    def relation_view(self, kind: str | None = None) -> DataFrame:
        return self.relations if kind is None else self.relations.filter(self.relations["type"] == kind)

    def node(self, item_id: str, id_: int) -> DataFrame:
        return self.nodes.filter((self.nodes["item_id"] == item_id) & (self.nodes["id"] == id_)).limit(1)

    def propagate(self, policy: Policy = Policy()) -> DataFrame:
        return propagation.propagated(self.nodes, self.relations, policy)

    def prune(self) -> DataFrame:
        return evidence.pruned(self.nodes, self.evidence)

    def merge(self, threshold: float, incremental: bool = False) -> "Memory":
        kept, moved, _ = merge.merge_pass(self.nodes, self.relations, threshold, incremental)
        return Memory(kept, moved, self.evidence)

    def closure(self, depth: int = 5) -> DataFrame:
        return graph.support_closure(self.nodes, self.relations, depth)

    def select(self, queries: DataFrame, strategy: str = "focused", budget_chars: int = 6600, depth: int = 4) -> DataFrame:
        """queries: item_id, query (the family), text."""
        similar = retrieval.similarities(retrieval.units(self.nodes), queries)
        edges = R.coherent(self.relations, self.nodes) if strategy == "focused" else self.relations
        return selection.select(self.nodes, edges, similar, strategy, budget_chars, depth)

    def render(self, chars: int = 6600) -> DataFrame:
        return budget.rendered_nodes(self.nodes, chars)

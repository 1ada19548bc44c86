"""Token usage and its price."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def coerced_usage(usage: Column) -> Column:
    """Struct (prompt, completion, total, reasoning, cost) from a usage object of any of the common shapes (a variant)."""

    def first(kind: str, *paths: str) -> Column:
        return F.coalesce(*(F.try_variant_get(usage, p, kind) for p in paths))

    prompt = F.coalesce(first("long", "$.prompt_tokens", "$.input_tokens", "$.input"), F.lit(0))
    completion = F.coalesce(first("long", "$.completion_tokens", "$.output_tokens", "$.output"), F.lit(0))
    total = F.coalesce(first("long", "$.total_tokens", "$.total", "$.totalTokens"), prompt + completion)
    reasoning = F.coalesce(first("long", "$.completion_tokens_details.reasoning_tokens", "$.output_tokens_details.reasoning_tokens", "$.reasoning_tokens", "$.reasoning"), F.lit(0))
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), total.alias("total"), reasoning.alias("reasoning"), first("double", "$.cost", "$.total_cost", "$.cost.total").alias("cost"))


def estimated_cost(prompt: Column, completion: Column, per_1k_in: float, per_1k_out: float) -> Column:
    return F.round(prompt / 1000.0 * per_1k_in + completion / 1000.0 * per_1k_out, 6)


def is_embedding(label: Column) -> Column:
    return (label == "embedding") | label.startswith("embedding:")

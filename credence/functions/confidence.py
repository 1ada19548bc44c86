"""Confidence as column expressions: priors, evidence, posteriors, and what relations carry.

Rounding: Spark's round is half-up on the decimal form. `python_round` gives the correctly rounded half-even of the
binary value for exact parity; it is the only Python here, and only `exact=True` uses it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

LOW, HIGH = 0.001, 0.999
DEFAULT_PRIOR, DEFAULT_WEIGHT, DEFAULT_THRESHOLD, MIN_DELTA, MAX_ROUNDS = 0.55, 0.5, 0.8, 0.001, 3

#: Prior by role and stance of the table policy, then reliability by role.
PRIORS = {
    "user": {"asserted": 0.88, "recalled": 0.78, "judged": 0.72, "speculated": 0.58},
    "tool": {"asserted": 0.88, "recalled": 0.78, "judged": 0.74, "speculated": 0.62},
    "assistant": {"asserted": 0.78, "recalled": 0.68, "judged": 0.65, "speculated": 0.45},
}
ROLE_RELIABILITY = {"user": 0.85, "tool": 0.80, "assistant": 0.65}
STANCE_QUALITY = {"asserted": 0.75, "recalled": 0.65, "judged": 0.55, "speculated": 0.35}


@dataclass(frozen=True)
class Policy:
    """The weighted policy; its defaults are fixed values."""

    initial_method: str = "weighted_average"
    evidence_method: str = "product"
    source_weight: float = 0.5
    stance_weight: float = 0.5
    default_reliability: float = 0.55
    default_quality: float = 0.90
    reliability: dict = field(
        default_factory=lambda: {
            "user": 0.85, "assistant": 0.65, "tool": 0.80, "function": 0.80, "user_input": 0.85, "assistant_other": 0.65, "tool_call": 0.72, "tool_result": 0.90,
            "llm_reasoning": 0.58, "historical_retrieval": 0.70, "manual": 0.86, "unknown": 0.55,
        }
    )
    quality: dict = field(default_factory=lambda: {"asserted": 0.90, "recalled": 0.72, "judged": 0.65, "speculated": 0.40})
    default_weight: float = DEFAULT_WEIGHT
    threshold: float = DEFAULT_THRESHOLD
    min_delta: float = MIN_DELTA
    max_rounds: int = MAX_ROUNDS

    @classmethod
    def of(cls, config: dict | None) -> "Policy":
        """A policy from a loose mapping: scores clamped to 0..1, rounds to 1..3, unknown methods rejected."""
        c, base = dict(config or {}), cls()
        one = lambda x, d: min(1.0, max(0.0, float(d if x is None else x)))
        spread = c.get("relation_propagation") or {}
        methods = {"weighted_average", "product", "min", "max"}
        first, then = c.get("initial_method") or base.initial_method, c.get("evidence_method") or base.evidence_method
        if not {first, then} <= methods:
            raise ValueError(f"unknown method: {first}, {then}")
        return cls(
            first, then, max(0.0, float(c.get("source_weight", base.source_weight))), max(0.0, float(c.get("stance_weight", base.stance_weight))),
            one(c.get("default_source_reliability"), base.default_reliability), one(c.get("default_stance_quality"), base.default_quality),
            {k: one(v, 0) for k, v in {**base.reliability, **(c.get("source_reliability") or {})}.items()}, {k: one(v, 0) for k, v in {**base.quality, **(c.get("stance_quality") or {})}.items()},
            one(spread.get("default_relation_weight"), base.default_weight), one(spread.get("input_confidence_threshold"), base.threshold),
            max(0.0, float(spread.get("min_confidence_delta", base.min_delta))), min(MAX_ROUNDS, max(1, int(spread.get("max_iterations", base.max_rounds)))),
        )


@F.pandas_udf(T.DoubleType())
def _half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits)], dtype="float64")


def python_round(x: Column, digits: int) -> Column:
    return _half_even(x, F.lit(digits))


def _lookup(key: Column, table: dict, default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default)


def norm_role(role: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(r == "function", "tool").otherwise(r)


def norm_stance(stance: Column) -> Column:
    """Unknown stances count as asserted (table policy)."""
    s = F.lower(F.trim(F.coalesce(stance, F.lit("asserted"))))
    return F.when(s.isin(*STANCE_QUALITY), s).otherwise(F.lit("asserted"))


def strict_stance(stance: Column) -> Column:
    """Unknown stances are an error (weighted policy)."""
    s = F.lower(F.trim(stance))
    return F.when(s.isin(*STANCE_QUALITY), s).otherwise(F.raise_error(F.concat(F.lit("unknown stance: "), F.coalesce(stance, F.lit("null")))))


def prior(role: Column, stance: Column) -> Column:
    """The table policy: twelve cells; other roles have the default."""
    r, s = norm_role(role), norm_stance(stance)
    out = None
    for name, row in PRIORS.items():
        cell = _lookup(s, row, F.lit(ROLE_RELIABILITY[name]))
        out = F.when(r == name, cell) if out is None else out.when(r == name, cell)
    return out.otherwise(F.lit(DEFAULT_PRIOR))


def _combined(a: Column, b: Column, method: str, p: Policy) -> Column:
    if method == "product":
        return a * b
    if method == "min":
        return F.least(a, b)
    if method == "max":
        return F.greatest(a, b)
    total = p.source_weight + p.stance_weight
    return (a * p.source_weight + b * p.stance_weight) / total if total > 0 else (a + b) / 2.0


def weighted_prior(source: Column, stance: Column, policy: Policy = Policy()) -> Column:
    a = _lookup(F.lower(F.trim(source)), policy.reliability, F.lit(policy.default_reliability))
    return _combined(a, _lookup(strict_stance(stance), policy.quality, F.lit(policy.default_quality)), policy.initial_method, policy)


def evidence_score(role: Column, stance: Column) -> Column:
    """What one evidence record adds, table policy."""
    return _lookup(norm_role(role), ROLE_RELIABILITY, F.lit(DEFAULT_PRIOR)) * _lookup(norm_stance(stance), STANCE_QUALITY, F.lit(0.75))


def weighted_evidence_score(source: Column, stance: Column, policy: Policy = Policy()) -> Column:
    a = _lookup(F.lower(F.trim(source)), policy.reliability, F.lit(policy.default_reliability))
    return _combined(a, _lookup(strict_stance(stance), policy.quality, F.lit(policy.default_quality)), policy.evidence_method, policy)


def source_type(role: Column, method: Column, text: Column) -> Column:
    """The fine-grained source of a node, by how and where it was found."""
    r = norm_role(role)
    thinking = F.coalesce(text, F.lit("")).rlike("(?i)<think>|</think>")
    return (
        F.when(method.isin("rule_tool_call"), "tool_call").when(method.isin("rule_tool_result", "compact_llm_tool_result") | (r == "tool"), "tool_result")
        .when(r == "user", "user_input").when((r == "assistant") & thinking, "llm_reasoning").otherwise("assistant_other")
    )


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))


def logit(p: Column) -> Column:
    q = clamp(p)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def posterior(initial: Column, evidence: Column, factors: Column, exact: bool = False) -> Column:
    """Clamped before it is rounded to three places, so never 0 or 1. A prior of 0 or null is the default."""
    start = F.coalesce(F.nullif(initial, F.lit(0.0)), F.lit(DEFAULT_PRIOR))
    x = clamp(sigmoid(logit(start) + F.coalesce(evidence, F.lit(0.0)) + F.coalesce(factors, F.lit(0.0))))
    return python_round(x, 3) if exact else F.round(x, 3)


def public_posterior(source: Column, stance: Column, evidence: Column, factors: Column) -> Column:
    """The typed model's form: the prior is the mean of two dimensions, and the result isn't clamped again."""
    return sigmoid(logit((source + stance) / 2) + evidence + factors)


# -- relations ---------------------------------------------------------------------------------------------------------


def relation_output(kind: Column, from_id: Column, to_id: Column) -> Column:
    """The node a relation acts on: A depends_on B lets B support A; A contradicts B lets A lower B; others carry nothing."""
    return F.when(kind == "depends_on", from_id).when(kind == "contradicts", to_id)


def relation_input(kind: Column, from_id: Column, to_id: Column) -> Column:
    return F.when(kind == "depends_on", to_id).when(kind == "contradicts", from_id)


def relation_sign(kind: Column) -> Column:
    return F.when(kind == "depends_on", 1).when(kind == "contradicts", -1)


def relation_weight(weight: Column, default: float = DEFAULT_WEIGHT) -> Column:
    w = F.coalesce(F.nanvl(weight.cast("double"), F.lit(None).cast("double")), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))


def relation_threshold(threshold: Column, default: float = DEFAULT_THRESHOLD) -> Column:
    t = F.coalesce(F.nanvl(threshold.cast("double"), F.lit(None).cast("double")), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def activation(confidence: Column, threshold: Column) -> Column:
    """0 at or below the threshold, then linear up to 1. A threshold of 1 lets nothing through."""
    return F.when((confidence > threshold) & (threshold < 1), (confidence - threshold) / (1 - threshold)).otherwise(F.lit(0.0))


def is_procedural(method: Column, query: Column, arguments: Column, items: Column) -> Column:
    """Tool calls and queries: they can't be supported, only contradicted. Empty strings and objects count as absent."""
    has = lambda c: F.coalesce((c != "") & (c != "{}") & (c != "[]"), F.lit(False))
    return F.coalesce(method == "rule_tool_call", F.lit(False)) | has(query) | (has(arguments) & ~F.coalesce(F.size(items) > 0, F.lit(False)))

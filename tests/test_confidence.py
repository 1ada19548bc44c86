"""Golden numbers of confidence, evidence and propagation."""

import pytest
from pyspark.sql import functions as F

from credence.functions import confidence as C
from credence.operators import evidence as E, propagation as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("role, stance, want", [("user", "asserted", 0.88), ("assistant", "speculated", 0.45), ("function", "judged", 0.74), ("narrator", "asserted", 0.55), ("user", "whatever", 0.88), (None, None, 0.55)])
def test_prior(spark, role, stance, want):
    assert one(spark, C.prior(F.lit(role).cast("string"), F.lit(stance).cast("string"))) == want


def test_posterior_is_never_certain(spark):
    assert one(spark, C.posterior(F.lit(0.78), F.lit(100.0), F.lit(0.0))) == 0.999
    assert one(spark, C.posterior(F.lit(0.78), F.lit(-100.0), F.lit(0.0))) == 0.001
    assert one(spark, C.posterior(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == one(spark, C.posterior(F.lit(0.55), F.lit(0.0), F.lit(0.0))) == 0.55


def test_python_rounding_is_half_even_on_the_binary_value(spark):
    assert one(spark, C.python_round(F.lit(0.0625), 3)) == round(0.0625, 3) == 0.062


def test_weighted_policy(spark):
    assert one(spark, F.round(C.weighted_prior(F.lit("user"), F.lit("asserted")), 6)) == 0.875
    with pytest.raises(Exception):
        one(spark, C.weighted_prior(F.lit("user"), F.lit("guessed")))
    p = C.Policy.of({"initial_method": "min", "source_reliability": {"user": 7}, "relation_propagation": {"max_iterations": 99}})
    assert p.reliability["user"] == 1.0 and p.max_rounds == 3
    with pytest.raises(ValueError):
        C.Policy.of({"initial_method": "sum"})


NODE = "item_id string, id long, confidence double, initial_confidence double, evidence_confidence double, factor_confidence double, procedural boolean"
EDGE = "item_id string, id long, from_id long, to_id long, type string, weight double, threshold double"


def graph(spark, confidences, edges, procedural=()):
    n = [("a", i, c, c, 0.0, 0.0, i in procedural) for i, c in confidences.items()]
    return spark.createDataFrame(n, NODE), spark.createDataFrame([("a", *e) for e in edges], EDGE)


def test_contribution(spark):
    n, r = graph(spark, {1: 0.5, 2: 0.81}, [(1, 1, 2, "depends_on", 0.5, 0.8)])
    x = P.contributions(n, r).first()
    assert (x["output_id"], x["input_id"]) == (1, 2) and x["strength"] == pytest.approx(0.05) and x["contribution"] == pytest.approx(0.025)
    n, r = graph(spark, {1: 0.5, 2: 0.9}, [(1, 1, 2, "depends_on", 8.0, 0.0)])
    assert P.contributions(n, r).first()["contribution"] == pytest.approx(0.9)


def test_only_the_strongest_of_each_sign_counts(spark):
    n, r = graph(spark, {0: 0.5, 1: 0.9, 2: 0.85, 3: 0.95}, [(1, 0, 1, "depends_on", 1.0, 0.0), (2, 0, 2, "depends_on", 1.0, 0.0), (3, 3, 0, "contradicts", 1.0, 0.0)])
    x = P.strongest(P.contributions(n, r)).first()
    assert x["factor"] == pytest.approx(-0.05) and x["relation_ids"] == [1, 3]


def test_procedural_outputs_and_inactive_inputs(spark):
    n, r = graph(spark, {0: 0.5, 1: 0.9}, [(1, 0, 1, "depends_on", 1.0, 0.0)], procedural={0})
    assert P.contributions(n, r).isEmpty()
    n, r = graph(spark, {0: 0.5, 1: 0.8}, [(1, 0, 1, "depends_on", 1.0, 0.8)])
    assert P.contributions(n, r).isEmpty()


def test_rounds_are_synchronous(spark):
    n, r = graph(spark, {0: 0.5, 1: 0.5, 2: 0.5}, [(1, 2, 1, "depends_on", 1.0, 0.0), (2, 1, 0, "depends_on", 1.0, 0.0)])
    got = {x["id"]: x["confidence"] for x in P.propagated(n, r, C.Policy(min_delta=0.0), rounds=1).collect()}
    assert got == {0: 0.5, 1: 0.622, 2: 0.622}


EV = "item_id string, id long, text string, turn_id long, role string, stance string"


def test_later_turns_corroborate_once_each(spark):
    ev = spark.createDataFrame([("a", 10, "made", 8, "tool", "recalled"), ("a", 11, "x one", 9, "tool", "recalled"), ("a", 12, "x two", 9, "tool", "recalled"), ("a", 13, "y", 10, "tool", "recalled")], EV)
    n = spark.createDataFrame([("a", 1, 8, [10, 11, 12, 13], 1)], "item_id string, id long, turn_id long, evidence_ids array<long>, initial_evidence_count long")
    rows = E.additional(n, ev).withColumn("score", C.evidence_score(F.col("role"), F.col("stance")))
    x = E.summed(E.independent(rows)).first()
    assert x["evidence_confidence"] == pytest.approx(1.04) and x["evidence_ids"] == [11, 13]
    assert one(spark, C.posterior(F.lit(0.78), F.lit(1.04), F.lit(0.0))) == 0.909
    assert E.additional(n.withColumn("turn_id", F.lit(9).cast("long")).withColumn("evidence_ids", F.array(F.lit(11).cast("long"))), ev).isEmpty()


def test_repeated_urls_are_one_observation(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1, "see https://x.org/a.", 0.5), ("a", 1, 2, 3, "other words https://X.org/a/", 0.5), ("a", 1, 3, 4, "fresh", 0.4)], "item_id string, node_id long, id long, turn_id long, text string, score double")
    assert [x["id"] for x in E.independent(rows).orderBy("id").collect()] == [1, 3]

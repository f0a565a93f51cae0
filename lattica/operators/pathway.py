"""Questions to a network: nodes near active targets that meet weighted conditions, with confidence.

Nodes are rows (node, activation, strength, accesses), connections rows (src, dst, weight).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Activation and weight that a pathway follows, its length, the score of a match, and what each condition gives.
ACTIVE, STRONG, LENGTH, MATCH = 0.5, 0.7, 50, 0.5
EQUAL, EQUAL_NOT, COMPARED, LIKE = 0.9, 0.1, 0.8, 0.7


def pathway(targets: DataFrame, nodes: DataFrame, links: DataFrame, active: float = ACTIVE, length: int = LENGTH) -> DataFrame:
    """(node): active targets and what their strong connections lead to, the `length` least nodes of them.

    Only connections of active targets are read on; targets that are no node lead nowhere.
    """
    awake = nodes.where(F.col("activation") > active).select("node").join(targets.select("node").distinct(), "node", "left_semi")
    led = links.where(F.col("weight") > STRONG).join(awake.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    return awake.unionByName(led).distinct().orderBy("node").limit(length)


def _met(operator: str, value: str) -> Column:
    """What a condition on a node's strength gives."""

    def number(default: float) -> float:
        try:
            return float(value)
        except ValueError:
            return default

    if operator in ("=", "=="):
        return F.when(F.col("strength") > 0.5, EQUAL).otherwise(EQUAL_NOT)
    if operator == ">":
        return F.when(F.col("strength") > number(0.0), COMPARED).otherwise(0.0)
    if operator == "<":
        return F.when(F.col("strength") < number(1.0), COMPARED).otherwise(0.0)
    return F.lit(LIKE if operator == "LIKE" else 0.0)


def matches(path: DataFrame, nodes: DataFrame, links: DataFrame, conditions: list[tuple[str, str, float]]) -> DataFrame:
    """(node, score, confidence) of a pathway's nodes whose conditions (operator, value, weight) sum up above MATCH.

    Confidence is the strength, a tenth of the magnitude of the accesses and 0.3 of the mean connection, between 0 and 1;
    a node that was never accessed has none.
    """
    score = reduce(lambda a, c: a + c[2] * _met(c[0], c[1]), conditions, F.lit(0.0))
    found = nodes.join(path, "node", "left_semi").withColumn("score", score).where(F.col("score") > MATCH)
    pull = links.withColumnRenamed("src", "node").join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.avg(F.abs("weight")).alias("pull"))
    sure = F.col("strength") + F.log10("accesses") / 10 + 0.3 * F.coalesce("pull", F.lit(0.0))
    bounded = F.when(F.col("accesses") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure))).otherwise(0.0)
    return found.join(pull, "node", "left").select("node", "score", bounded.alias("confidence"))

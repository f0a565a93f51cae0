"""Plasticity of a network: capacity, decay of use, and consolidation of nodes that hardly change.

Nodes are rows (node, cluster, score, uses), connections rows (src, dst, uses). A null cluster is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the capacity to warn and to consolidate at, nodes of a round, the score below which a node is
# consolidated, the uses a connection needs, the share of a target's score that stays, and what of the uses a decay leaves.
WARN_AT, CONSOLIDATE_AT, BATCH, LOW_SCORE, LEAST_USES, KEPT_SCORE, DECAY = 0.8, 0.9, 100, 0.1, 2, 0.7, 0.95


def capacity(nodes: DataFrame, most: int) -> DataFrame:
    """One row (nodes, utilisation, state): free, warn or consolidate."""
    used = F.col("nodes") / most
    return nodes.agg(F.count("*").alias("nodes")).withColumn("utilisation", used).withColumn("state", F.when(used >= CONSOLIDATE_AT, "consolidate").when(used >= WARN_AT, "warn").otherwise("free"))


def faded(uses: Column, decay: float = DECAY) -> Column:
    """What a decay leaves of a number of uses, rounded down."""
    return F.floor(uses * decay).cast("long")


def _fates(nodes: DataFrame, batch: int) -> DataFrame:
    """(node, cluster, score, uses, target) of the nodes that go, at most `batch`: target is null for those removed.

    The lowest scores go first, equal ones by node. A node joins the highest of its cluster above LOW_SCORE (equal ones:
    the least node) and is removed if there is none and its score is below half of LOW_SCORE.
    """
    low = nodes.where(F.col("score") < LOW_SCORE).orderBy("score", "node").limit(batch)
    best = nodes.where((F.col("score") > LOW_SCORE) & F.col("cluster").isNotNull()).groupBy("cluster").agg(F.max(F.struct("score", (-F.col("node")).alias("k"))).alias("t"))
    met = low.join(best.select("cluster", (-F.col("t.k")).alias("target")), "cluster", "left")
    return met.where(F.col("target").isNotNull() | (F.col("score") < LOW_SCORE / 2)).select("node", "cluster", "score", "uses", "target")


def consolidated(nodes: DataFrame, links: DataFrame, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Nodes and connections after one round.

    A target takes its sources' uses, and its score moves towards each of theirs in turn, lowest first. Connections of
    nodes that went and those used less than LEAST_USES times go. Targets are picked before the round begins.
    """
    fates = _fates(nodes, batch)
    # at most `batch` rows in all, so a target's list is bounded
    taken = fates.where("target is not null").groupBy(F.col("target").alias("node")).agg(F.sum("uses").alias("more"), F.array_sort(F.collect_list(F.struct("score", "node"))).alias("from"))
    score = F.aggregate("from", F.col("score").cast("double"), lambda t, s: F.least(F.lit(1.0), KEPT_SCORE * t + (1 - KEPT_SCORE) * s["score"]))
    stay = nodes.join(fates.select("node"), "node", "left_anti").join(taken, "node", "left")
    left = stay.select("node", "cluster", F.when(F.col("from").isNull(), F.col("score")).otherwise(score).alias("score"), (F.col("uses") + F.coalesce("more", F.lit(0))).alias("uses"))
    gone = fates.select("node")
    held = links.where(F.col("uses") >= LEAST_USES).join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return left, held.select("src", "dst", "uses")

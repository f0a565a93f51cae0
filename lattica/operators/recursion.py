"""Recursive closure over an edge table, safe on cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Versions

# Fixed value: rounds before recursion counts as endless.
MAX_DEPTH = 1000
#: Rounds whose rows are put together as one table, so that no plan reads more tables than that.
ROUNDS = 8


def closure(start: DataFrame, edges: DataFrame, distinct: bool = True, max_depth: int = MAX_DEPTH, guard: str | None = None) -> DataFrame:
    """Nodes reached from start (node) over edges (src, dst), as (node, depth).

    distinct: a node counts once, at its least depth (UNION); else once for every path (UNION ALL). guard is a condition on
    node and depth that rows must meet to go on. Raises RecursionError at max_depth rounds.
    """
    tables = Versions(start.sparkSession, "recursion")
    first = start.select("node", F.lit(0).alias("depth"))
    frontier = tables.write(first.distinct() if distinct else first, "frontier")
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        if depth > max_depth:
            raise RecursionError(f"recursion went past {max_depth} rounds")
        going = frontier.where(guard) if guard else frontier
        step = going.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(depth).alias("depth"))
        if distinct:
            step = step.distinct().join(seen.select("node"), "node", "left_anti")
        frontier = tables.write(step, "frontier")
        seen = seen.unionByName(frontier)
        if depth % ROUNDS == 0:
            seen = tables.write(seen, "seen")
    return seen

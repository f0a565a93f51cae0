"""Search and small combinatorial optimisation: closed-form amplitude search, exact and annealed quadratic binary problems."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def amplitude_search(counts: DataFrame) -> DataFrame:
    """counts (n, m: items and marked ones) with the best number of iterations and the chance to measure a marked item."""
    theta = F.asin(F.sqrt(F.col("m") / F.col("n")))
    k = F.when(F.col("m") > 0, F.floor(F.lit(np.pi / 4) * F.sqrt(F.col("n") / F.greatest("m", F.lit(1))))).otherwise(0).cast("long")
    return counts.withColumn("iterations", k).withColumn("probability", F.when(F.col("m") > 0, F.pow(F.sin((2 * F.col("iterations") + 1) * theta), 2)).otherwise(F.lit(0.0)))


def substring_positions(df: DataFrame, column: str, needle: str, into: str = "positions") -> DataFrame:
    """df with the 1-based places of a substring, overlaps included."""
    n = F.length(column) - len(needle) + 1
    every = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(into, F.filter(every, lambda i: F.substring(F.col(column), i, F.lit(len(needle))) == needle))


def max_cut(edges: DataFrame) -> DataFrame:
    """Coefficients (i, j, q) of edges (i, j, w): x' Q x is minus the weight of the cut."""
    return edges.select("i", "j", (2 * F.col("w")).alias("q")).unionByName(edges.select("i", F.col("i").alias("j"), (-F.col("w")).alias("q"))).unionByName(edges.select(F.col("j").alias("i"), "j", (-F.col("w")).alias("q"))).groupBy("i", "j").agg(F.sum("q").alias("q"))


def colouring(edges: DataFrame, colours: int, penalty: float = 10.0) -> DataFrame:
    """Coefficients of a graph colouring over variables node * colours + colour: one colour a node, none shared by neighbours."""
    nodes = edges.select(F.col("i").alias("v")).union(edges.select("j")).distinct()
    c = F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))
    own = nodes.select("v", c.alias("c")).select((F.col("v") * colours + F.col("c")).alias("i"), (F.col("v") * colours + F.col("c")).alias("j"), F.lit(-penalty).alias("q"))
    pairs = nodes.select("v", c.alias("c")).select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("e")).where("c < e").select((F.col("v") * colours + F.col("c")).alias("i"), (F.col("v") * colours + F.col("e")).alias("j"), F.lit(2 * penalty).alias("q"))
    clash = edges.select("i", "j", c.alias("c")).select((F.col("i") * colours + F.col("c")).alias("i"), (F.col("j") * colours + F.col("c")).alias("j"), F.lit(penalty).alias("q"))
    return own.unionByName(pairs).unionByName(clash).groupBy("i", "j").agg(F.sum("q").alias("q"))


def tour(distances: DataFrame, n: int) -> DataFrame:
    """Coefficients of a shortest tour of n places by distances (i, j, d), over variables place * n + time.

    Steps cost their distance; a place at two times or a time with two places costs twice the longest distance, and each
    place and time that is filled wins as much.
    """
    most = distances.agg((2 * F.max("d")).alias("p"))  # one row
    times = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end)))
    at = lambda place, time: F.col(place) * n + F.col(time)
    steps = distances.where("i != j").select("i", "j", "d", times(n - 2).alias("t")) if n > 1 else distances.limit(0).withColumn("t", F.lit(0))
    cost = steps.select(at("i", "t").alias("i"), (F.col("j") * n + F.col("t") + 1).alias("j"), "d").withColumnRenamed("d", "q")
    spark = distances.sparkSession
    cells = spark.range(n).select(F.col("id").alias("v"), times(n - 1).alias("t")).withColumn("u", times(n - 1))
    pairs = cells.where("t != u").select(at("v", "t").alias("i"), at("v", "u").alias("j"), F.lit(1.0).alias("w"))  # one place, two times
    pairs = pairs.unionByName(cells.where("t != u").select((F.col("t") * n + F.col("v")).alias("i"), (F.col("u") * n + F.col("v")).alias("j"), F.lit(1.0).alias("w")))  # one time, two places
    own = cells.where("u = 0").select(at("v", "t").alias("i"), at("v", "t").alias("j"), F.lit(-2.0).alias("w"))
    rules = pairs.unionByName(own).crossJoin(F.broadcast(most)).select("i", "j", (F.col("w") * F.col("p")).alias("q"))
    return cost.unionByName(rules).groupBy("i", "j").agg(F.sum("q").alias("q"))


def ferromagnet(spark, n: int, coupling: float = 1.0) -> DataFrame:
    """Couplings (i, j, s) of n spins that all pull each other."""
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("j")).where("i < j").withColumn("s", F.lit(coupling))


def spin_glass(spark, n: int, disorder: float = 1.0, seed: int = 1) -> DataFrame:
    """Couplings (i, j, s) of n spins, uniform in plus or minus the disorder, the same for the same seed."""
    unit = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return ferromagnet(spark, n).withColumn("s", (2 * unit - 1) * disorder)


def field(schedule: str, share: float, first: float, power: float = 2.0) -> float:
    """The transverse field after a share of the run: from `first` towards zero."""
    return {"linear": first * (1 - share), "exponential": first * float(np.exp(-5 * share)), "polynomial": first * (1 - share) ** power}[schedule]


def best_iterations(counts: DataFrame) -> DataFrame:
    """counts (n, m) with the rounded best number of iterations."""
    return counts.withColumn("rounded", F.when(F.col("m") > 0, F.round(F.lit(np.pi / 4) * F.sqrt(F.col("n") / F.greatest("m", F.lit(1))))).otherwise(0).cast("long"))


def together(queries: dict[str, DataFrame]) -> DataFrame:
    """The rows of several queries in one result: (query, row as JSON), run as one job."""
    tagged = [df.select(F.lit(name).alias("query"), F.to_json(F.struct(*sorted(df.columns))).alias("row")) for name, df in sorted(queries.items())]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def to_ising(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Couplings (i, j, s) and fields (i, h) of x = (1 + s) / 2; the constant is ising_offset()."""
    couple = q.where("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("q") / 4).alias("s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    parts = q.where("i = j").select("i", (F.col("q") / 2).alias("h")).unionByName(q.where("i != j").select("i", (F.col("q") / 4).alias("h"))).unionByName(q.where("i != j").select(F.col("j").alias("i"), (F.col("q") / 4).alias("h")))
    return couple, parts.groupBy("i").agg(F.sum("h").alias("h"))


def ising_offset(q: DataFrame) -> DataFrame:
    """(offset): what the energy of the spins lacks to that of the binary problem."""
    return q.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("q") / 2).otherwise(F.col("q") / 4)).alias("offset"))


def solve_exact(q: DataFrame, n: int) -> DataFrame:
    """(state, energy) of all 2^n states of coefficients (i, j, q), n <= 20: the coefficients are a bounded array."""
    if n > 20:
        raise ValueError("exact solution is for at most 20 variables")
    spark = q.sparkSession
    coef = q.agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("q").cast("double").alias("q"))).alias("c"))  # at most n * n rows
    bit = lambda s, i: F.call_function("shiftright", s, i) % 2
    states = spark.range(1 << n).select(F.col("id").alias("state"))
    return states.crossJoin(F.broadcast(coef)).select("state", F.aggregate("c", F.lit(0.0), lambda a, x: a + x["q"] * bit(F.col("state"), x["i"]) * bit(F.col("state"), x["j"])).alias("energy"))


def anneal(q: DataFrame, n: int, replicas: int = 8, sweeps: int = 200, hot: float = 5.0, cold: float = 0.05, seed: int = 1, exchange: bool = False) -> DataFrame:
    """(problem, replica, state, energy): seeded annealing of each problem's coefficients (problem, i, j, q).

    exchange: replicas hold fixed temperatures and swap states (parallel tempering) instead of cooling.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((n, n))
        np.add.at(m, (rows["i"], rows["j"]), rows["q"])
        sym, diag = m + m.T - 2 * np.diag(np.diag(m)), np.diag(m)
        r = np.random.default_rng([seed, int(rows["problem"].iloc[0])])
        x = r.integers(0, 2, (replicas, n))
        energy = lambda s: np.einsum("ri,ij,rj->r", s, m, s)
        ladder = np.geomspace(cold, hot, replicas)
        best, low = x.copy(), energy(x)
        for sweep in range(sweeps):
            t = ladder if exchange else np.full(replicas, hot * (cold / hot) ** (sweep / max(1, sweeps - 1)))
            for k in r.permutation(n):
                change = (1 - 2 * x[:, k]) * (diag[k] + x @ sym[k])
                flip = r.random(replicas) < np.exp(-np.clip(change / t, 0, 700))
                x[flip, k] ^= 1
            e = energy(x)
            if exchange:
                for k in range(sweep % 2, replicas - 1, 2):
                    if r.random() < np.exp(min(0.0, (1 / t[k] - 1 / t[k + 1]) * (e[k] - e[k + 1]))):
                        x[[k, k + 1]], e[[k, k + 1]] = x[[k + 1, k]], e[[k + 1, k]]
            better = e < low
            best[better], low[better] = x[better], e[better]
        return pd.DataFrame({"problem": rows["problem"].iloc[0], "replica": np.arange(replicas), "state": best @ (1 << np.arange(n)), "energy": low})

    return q.groupBy("problem").applyInPandas(run, "problem long, replica long, state long, energy double")


def ising_anneal(couplings: DataFrame, n: int, field: float = 2.0, **options) -> DataFrame:
    """Annealing of transverse-field models: couplings (problem, i, j, s) with fields on i = j, as binary problems; energies
    are those of -sum s_ij z_i z_j - sum h_i z_i up to the offset."""
    pairs = couplings.where("i != j")
    q = pairs.select("problem", "i", "j", (-4 * F.col("s")).alias("q")).unionByName(pairs.select("problem", "i", F.col("i").alias("j"), (2 * F.col("s")).alias("q"))).unionByName(pairs.select("problem", F.col("j").alias("i"), "j", (2 * F.col("s")).alias("q"))).unionByName(couplings.where("i = j").select("problem", "i", "j", (-2 * F.col("s")).alias("q")))
    return anneal(q.groupBy("problem", "i", "j").agg(F.sum("q").alias("q")), n, hot=field, **options)

"""Learning over edge tables: strengthening, decay, winners, pruning, spike timing, propagation; and spiking neurons."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.neuro import activation

# Bounds of weights and plasticity, spike timing window and gains, winners' and losers' gains, LTP and LTD.
WEIGHT_BOUND, PLASTICITY_LOW, PLASTICITY_HIGH = 2.0, 0.1, 2.0
STDP_MS, STDP_PLUS, STDP_MINUS = 20.0, 0.1, 0.05
WIN_GAIN, LOSE_LOSS, LTP_FACTOR, LTD_RATE = 0.1, 0.05, 1.5, 0.1


def bounded(w: Column) -> Column:
    return F.least(F.lit(WEIGHT_BOUND), F.greatest(F.lit(-WEIGHT_BOUND), w))


def strengthen(edges: DataFrame, correlations: DataFrame, rate: float) -> DataFrame:
    """edges (src, dst, weight, plasticity) moved by correlations (src, dst, corr): w + rate * corr, plasticity towards 1."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("corr")))
    plastic = F.least(F.lit(PLASTICITY_HIGH), F.greatest(F.lit(PLASTICITY_LOW), 0.95 * F.col("plasticity") + 0.05))
    joined = edges.join(correlations, ["src", "dst"], "left")
    return joined.select("src", "dst", F.when(F.col("corr").isNull(), F.col("weight")).otherwise(bounded(F.col("weight") + rate * c)).alias("weight"), F.when(F.col("corr").isNull(), F.col("plasticity")).otherwise(plastic).alias("plasticity"))


def potentiate(edges: DataFrame, pairs: DataFrame, rate: float) -> DataFrame:
    """Long-term potentiation of pairs (src, dst, corr): strengthened by LTP_FACTOR times their correlation."""
    return strengthen(edges, pairs.withColumn("corr", LTP_FACTOR * F.col("corr")), rate)


def depress(edges: DataFrame, pairs: DataFrame, rate: float) -> DataFrame:
    """Long-term depression of pairs (src, dst): strengthened by minus LTD_RATE times the rate."""
    return strengthen(edges, pairs.select("src", "dst", F.lit(-LTD_RATE * rate).alias("corr")), rate)


def adaptive_rate(rate: float, recent: list[float], low: float = 0.001, high: float = 0.1) -> float:
    """The rate over one plus the variance of the last ten weights, within bounds; the rate itself before there are five."""
    last = recent[-10:]
    if len(recent) < 5:
        return rate
    return float(min(high, max(low, rate / (1 + np.var(last)))))


def inhibit(nodes: DataFrame, neighbours: DataFrame, strength: float) -> DataFrame:
    """nodes (id, activation, strength) after lateral inhibition by neighbours (active, id, distance): each active node takes
    strength * its own strength * exp(-distance^2 / 2) from a neighbour's activation, which stays at 0 or more."""
    active = nodes.select(F.col("id").alias("active"), F.col("strength").alias("by"))
    loss = neighbours.join(active, "active").groupBy("id").agg(F.sum(strength * F.col("by") * F.exp(-F.col("distance") * F.col("distance") / 2)).alias("loss"))
    return nodes.join(loss, "id", "left").select("id", F.greatest(F.lit(0.0), F.col("activation") - F.coalesce("loss", F.lit(0.0))).alias("activation"), "strength")


def payload_score(payload: Column, query: str, strength: Column) -> Column:
    """The share of the payload's windows that equal the query, more with the node's strength; 0 for a payload shorter than the query."""
    windows = F.length(payload) - len(query) + 1
    # overlapping places count: a look-ahead matches without taking characters
    found = F.regexp_count(payload, F.lit("(?=" + re.escape(query) + ")"))
    return F.when(windows > 0, found / windows * (1 + strength)).otherwise(F.lit(0.0))


def decay(edges: DataFrame, factor: float) -> DataFrame:
    return edges.withColumn("weight", F.col("weight") * factor)


def prune(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.abs("weight") >= threshold)


def winners(nodes: DataFrame, k: int, factor: float, group: str) -> DataFrame:
    """nodes (id, group, activation, weight): the k most active of a group gain, the others lose."""
    w = Window.partitionBy(group).orderBy(F.desc("activation"), "id")
    won = F.row_number().over(w) <= k
    return nodes.withColumn("weight", bounded(F.when(won, F.col("weight") + factor * F.col("activation") * WIN_GAIN).otherwise(F.col("weight") - factor * LOSE_LOSS)))


def stdp(spikes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weight changes (src, dst, change, pairs) of edges by spike times (node, ms): a range join within the window.

    Spikes are dealt to cells of the window's width; a spike meets those of its own and the two next cells, so the join
    is one of equal keys. Only the later side is repeated for the cells, so an edge meets each spike of its source once.
    """
    cell = F.floor(F.col("ms") / STDP_MS)
    pre = spikes.select(F.col("node").alias("src"), F.col("ms").alias("t1"), cell.alias("cell"))
    post = spikes.select(F.col("node").alias("dst"), F.col("ms").alias("t2"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    gap = F.col("t2") - F.col("t1")
    met = pre.join(edges.select("src", "dst"), "src").join(post, ["dst", "cell"]).where(F.abs(gap) <= STDP_MS)
    change = F.when(gap > 0, STDP_PLUS * F.exp(-gap / STDP_MS)).otherwise(-STDP_MINUS * F.exp(-F.abs(gap) / STDP_MS))
    return met.groupBy("src", "dst").agg(F.sum(change).alias("change"), F.count("*").alias("pairs"))


def learn_spikes(spikes: DataFrame, edges: DataFrame, rate: float) -> DataFrame:
    """edges (src, dst, weight, plasticity) strengthened by the sum of their spike pairs' changes."""
    return strengthen(edges, stdp(spikes, edges).select("src", "dst", F.col("change").alias("corr")), rate)


def propagate(nodes: DataFrame, edges: DataFrame, function: str = "sigmoid") -> DataFrame:
    """One hop: each target's weighted sum of its sources' outputs (id, output), activated."""
    met = edges.join(nodes, F.col("src") == F.col("id"))
    return met.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("output") * F.col("weight")).alias("net")).select("id", activation(F.col("net"), function).alias("output"))


# A, b, c, d of neuron types.
NEURONS = {"regular": (0.02, 0.2, -65.0, 8.0), "bursting": (0.02, 0.2, -55.0, 4.0), "chattering": (0.02, 0.2, -50.0, 2.0), "fast": (0.1, 0.2, -65.0, 2.0), "low_threshold": (0.02, 0.25, -65.0, 2.0), "thalamic": (0.02, 0.25, -65.0, 0.05), "resonator": (0.1, 0.26, -65.0, 2.0)}


def spike_trains(currents: DataFrame, kind: str = "regular") -> DataFrame:
    """currents (neuron, ms, current) to spikes (neuron, ms): one quadratic integrate-and-fire neuron a group, in time order."""
    a, b, c, d = NEURONS[kind]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ms")
        v, u, fired = c, b * c, []
        for ms, current in zip(rows["ms"], rows["current"]):
            for _ in range(2):  # two half steps of a millisecond
                v += 0.5 * (0.04 * v * v + 5 * v + 140 - u + current)
            u += a * (b * v - u)
            if v >= 30.0:
                fired.append(ms)
                v, u = c, u + d
        return pd.DataFrame({"neuron": np.full(len(fired), rows["neuron"].iloc[0]), "ms": np.array(fired, dtype="int64")})

    return currents.groupBy("neuron").applyInPandas(run, "neuron long, ms long")


# Time constants and reversal potentials of exciting and inhibiting synapses; gains, time and reach of their learning.
EXCITING, INHIBITING = (5.0, 0.0), (10.0, -70.0)
GAIN_PLUS, GAIN_MINUS, LEARN_MS, LEARN_REACH_MS = 0.005, 0.00525, 20.0, 100


def _simulated(synapses: pd.DataFrame, currents: pd.DataFrame, steps: int, learn: bool, kind: str) -> tuple[list, np.ndarray]:
    """The spikes (ms, neuron) of one network and the weights of its synapses at the end."""
    a, b, c, d = NEURONS[kind]
    ids = np.unique(np.concatenate([synapses["src"], synapses["dst"], currents["neuron"]])).astype(np.int64)
    pre, post = (np.searchsorted(ids, synapses[x].to_numpy()) for x in ("src", "dst"))
    weight, delay = np.abs(synapses["weight"].to_numpy(dtype=float)), synapses["delay"].to_numpy(dtype=int)
    inhibits = synapses["weight"].to_numpy(dtype=float) < 0
    tau, rest = (np.where(inhibits, i, e) for e, i in zip(EXCITING, INHIBITING))
    v, u = np.full(len(ids), c), np.full(len(ids), b * c)
    conductance, last = np.zeros(len(pre)), np.full(len(ids), -(10**9))
    arriving = np.zeros((int(delay.max(initial=1)) + 1, len(pre)))  # by time of arrival, in a ring
    given = np.zeros((steps + 1, len(ids)))
    inside = currents[(currents["ms"] >= 1) & (currents["ms"] <= steps)]
    np.add.at(given, (inside["ms"].to_numpy(dtype=int), np.searchsorted(ids, inside["neuron"].to_numpy())), inside["current"].to_numpy(dtype=float))
    spikes = []
    for t in range(1, steps + 1):
        slot = arriving[t % len(arriving)]
        conductance = (conductance + slot) * np.exp(-1 / tau)
        slot[:] = 0
        total = given[t] + np.bincount(post, conductance * (rest - v[post]), len(ids))
        for _ in range(2):
            v = v + 0.5 * (0.04 * v * v + 5 * v + 140 - u + total)
        u = u + a * (b * v - u)
        fired = v >= 30.0
        v, u = np.where(fired, c, v), np.where(fired, u + d, u)
        last[fired] = t
        spikes += [(t, n) for n in ids[fired].tolist()]
        sent = np.flatnonzero(fired[pre])
        arriving[(t + delay[sent]) % len(arriving), sent] += weight[sent]
        if learn:
            gap = t - last[pre]
            change = np.where(gap > 0, GAIN_PLUS * np.exp(-gap / LEARN_MS), -GAIN_MINUS)
            weight = np.where(fired[post] & (gap < LEARN_REACH_MS), np.clip(weight + change, 0.0, 1.0), weight)
    return spikes, np.where(inhibits, -weight, weight)


def spike_network(synapses: DataFrame, currents: DataFrame, steps: int, learn: bool = True, kind: str = "regular", weights: bool = False) -> DataFrame:
    """Spikes (network, neuron, ms) of networks of spiking neurons, or the weights (network, src, dst, weight) that they end with.

    synapses (network, src, dst, weight, delay in ms; a weight below 0 inhibits) and currents (network, neuron, ms from 1,
    current). A millisecond: arrived spikes raise conductances, which decay and drive the neurons; neurons step; spikes are
    sent; synapses of neurons that fired learn by the time since their source's last spike. Time runs in order, so a
    network is one group; many networks run side by side.
    """

    def run(key, s: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        fired, end = _simulated(s, i, steps, learn, kind)
        if weights:
            return pd.DataFrame({"network": key[0], "src": s["src"], "dst": s["dst"], "weight": end})
        return pd.DataFrame({"network": np.full(len(fired), key[0]), "neuron": np.array([n for _, n in fired], dtype="int64"), "ms": np.array([t for t, _ in fired], dtype="int64")})

    schema = "network long, src long, dst long, weight double" if weights else "network long, neuron long, ms long"
    return synapses.groupBy("network").cogroup(currents.groupBy("network")).applyInPandas(run, schema)

"""Consolidation of a network by a plain computation, and problems on a simulated register against all their states."""

import random

import numpy as np
import pytest

from lattica.operators import circuits, plasticity


def plain(nodes, links, batch):
    low = sorted((s, n) for n, _, s, _ in nodes if s < 0.1)[:batch]
    cluster, score, uses = ({n: x[k] for n, *x in nodes} for k in range(3))
    best = {}
    for n, c, s, _ in sorted(nodes, reverse=True):
        if c is not None and s > 0.1 and s >= best.get(c, (0, 0))[0]:
            best[c] = (s, n)
    gone = set()
    for s, n in low:
        if cluster[n] in best:
            t = best[cluster[n]][1]
            score[t], uses[t] = min(1.0, 0.7 * score[t] + 0.3 * s), uses[t] + uses[n]
        elif s >= 0.05:
            continue
        gone.add(n)
    return {(n, round(score[n], 9), uses[n]) for n in cluster if n not in gone}, {(a, b) for a, b, u in links if u >= 2 and not gone & {a, b}}


@pytest.mark.parametrize("batch", [0, 3, 100])
def test_consolidation(spark, batch):
    r = random.Random(batch)
    nodes = [(n, r.choice([None, 1, 2, 3, 4 if n % 9 == 0 else 3]), r.choice([0.01, 0.04, 0.06, 0.09, 0.1, 0.5, 0.5, 1.0]) if n % 9 else 0.02 + n / 1000, r.randrange(5)) for n in range(60)]
    links = [(a, b, r.randrange(5)) for a in range(60) for b in r.sample(range(60), 3)]
    n, l = plasticity.consolidated(spark.createDataFrame(nodes, "node long, cluster long, score double, uses long"), spark.createDataFrame(links, "src long, dst long, uses long"), batch)
    want = plain(nodes, links, batch)
    assert {(x["node"], round(x["score"], 9), x["uses"]) for x in n.collect()} == want[0]
    assert {(x["src"], x["dst"]) for x in l.collect()} == want[1]


def test_empty_network(spark):
    n, l = plasticity.consolidated(spark.createDataFrame([], "node long, cluster long, score double, uses long"), spark.createDataFrame([], "src long, dst long, uses long"))
    assert n.collect() == [] and l.collect() == []


def test_registers(spark):
    r = np.random.default_rng(3)
    i, j = np.triu_indices(6)
    rows = [(p, int(a), int(b), float(q)) for p in range(3) for a, b, q in zip(i, j, r.normal(size=len(i)))]
    least = {}
    for p in range(3):
        m = np.zeros((6, 6))
        for k, a, b, q in rows:
            if k == p:
                m[a, b] += q
        states = np.array([[s >> k & 1 for k in range(6)] for s in range(64)])
        energy = np.array([x @ m @ x for x in states])
        least[p] = (int(energy.argmin()), round(float(energy.min()), 9))
        assert np.allclose(circuits._energies(*np.nonzero(m), m[np.nonzero(m)], 6), energy)
    q = spark.createDataFrame(rows, "problem long, i long, j long, q double")
    for method in circuits.METHODS:
        assert {x["problem"]: (x["state"], round(x["energy"], 9)) for x in circuits.simulated(q, 6, method).collect()} == least
    with pytest.raises(ValueError):
        circuits.simulated(q, 15, "evolved")


def test_flat_problem():
    for chances in circuits.METHODS.values():
        assert chances(np.zeros(4), 2, seed=1).sum() == pytest.approx(1)

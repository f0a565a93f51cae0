"""Advice, plan cache, questions, the codec's dictionary and repairs, as-of joins, learning rates, filters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import advisor
from lattica.functions import dna, neuro
from lattica.operators import learning, optimise, signal
from lattica.operators.asof import asof


def test_advice():
    a = advisor.Advisor({"orders": ["o_id", "o_user", "o_note"], "users": ["u_id", "name"]})
    for _ in range(6):
        a.note("SELECT * FROM orders JOIN users ON orders.o_user = users.u_id WHERE o_id = 3 ORDER BY name")
    for _ in range(6):
        a.note("SELECT o_id FROM orders WHERE o_note LIKE '%o_user = 1%' GROUP BY o_id")
    assert a.score("orders", "o_user") == pytest.approx(2 * 6 / 12 + 0.3)
    assert a.score("orders", "o_id") == pytest.approx((6 + 6) / 12 + 0.6)
    assert a.score("orders", "o_note") == pytest.approx(6 / 12 - 0.3)
    assert [(t, c) for t, c, _ in a.advice()] == [("orders", "o_id"), ("orders", "o_user"), ("orders", "o_note")]


def test_plan_cache():
    now = [0.0]
    cache = advisor.PlanCache(2, clock=lambda: now[0])
    assert [cache.get(x, str.upper) for x in ("a", "b", "a")] == ["A", "B", "A"]
    now[0] = 50
    cache.get("c", str.upper)
    assert set(cache.held) == {"a", "c"} and (cache.hits, cache.misses) == (1, 3)


def test_questions():
    tables = {"customer": ["c_acctbal", "c_nationkey"], "part": ["p_name"]}
    assert advisor.statement("How many customers with c_acctbal above 100?", tables) == "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal > 100"
    assert advisor.statement("show customers where c_acctbal less than -5 and c_nationkey equal to 3", tables) == "SELECT * FROM customer WHERE c_acctbal < -5 AND c_nationkey = 3"
    assert advisor.statement("find parts similar to 'red ring'", tables) == "SELECT * FROM part NEUROMATCH 'red ring'"
    with pytest.raises(ValueError):
        advisor.statement("what is the weather", tables)


def test_dictionary_and_repairs(spark):
    r = random.Random(2)
    for data in (b"", b"short", b"abcdabcdabcd" * 9, bytes(r.randrange(256) for _ in range(500)), b"\xff" * 90 + b"abc", "the same words and the same words again ".encode() * 20):
        entries, short = dna.shortened(data)
        assert dna.lengthened(entries, short) == data
    assert len(dna.shortened(b"the same words and " * 40)[1]) < 200
    d = spark.createDataFrame([("A" * 10 + "TTTT" + "G" * 9,), (None,), ("",), ("C" * 8,)], "s string")
    assert [x[0] for x in d.select(dna.break_runs(F.col("s"))).collect()] == ["AAATAAATAATTTTGGGCGGGCG", None, "", "C" * 8]
    assert dna.balanced("A" * 10 + "G" + "T" * 14) == "A" * 11 + "T" * 14 and dna.balanced("ATGC" * 10) == "ATGC" * 10
    assert dna.balanced("G" * 10 + "T" + "C" * 14) == "G" * 10 + "C" * 15
    coded = spark.createDataFrame([("TAGA",), ("TAG",), ("TAGX",), ("",), (None,)], "s string")
    assert [x[0] for x in coded.select(dna.decode(F.col("s")).cast("string")).collect()] == ["H", None, None, "", None]


def test_asof_by_brute_force(spark):
    r = random.Random(4)
    day = "2024-01-%02d %02d:00:00"
    left = [(i, r.choice(["a", "b", None]), r.choice([None, day % (r.randint(1, 9), r.randint(0, 23))])) for i in range(80)]
    right = [(100 + i, r.choice(["a", "b", "c"]), day % (r.randint(1, 9), r.randint(0, 23))) for i in range(40)]
    schema = "id long, k string, t string"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("t", F.to_timestamp("t"))
    got = {x["id"]: str(x["met"]["t"]) if x["met"] else None for x in asof(frame(left), frame(right), "k", "t").collect()}
    assert got == {i: max((u for _, k2, u in right if k is not None and t is not None and k2 == k and u <= t), default=None) for i, k, t in left}


def test_learning_and_filters(spark):
    assert learning.adaptive_rate(0.05, [1, 2]) == 0.05 and learning.adaptive_rate(0.05, [0.0, 2.0] * 5) == pytest.approx(0.025)
    edges = spark.createDataFrame([(1, 2, 1.9, 1.0), (3, 4, 0.0, 1.5)], "src long, dst long, weight double, plasticity double")
    strong = learning.potentiate(edges, spark.createDataFrame([(1, 2, 0.4), (3, 4, 5.0)], "src long, dst long, corr double"), 0.5)
    assert {(x["src"], round(x["weight"], 6), round(x["plasticity"], 6)) for x in strong.collect()} == {(1, 2.0, 1.0), (3, 0.5, 1.475)}
    weak = learning.depress(edges, spark.createDataFrame([(3, 4)], "src long, dst long"), 0.5)
    assert {(x["src"], round(x["weight"], 6)) for x in weak.collect()} == {(1, 1.9), (3, -0.025)}
    t = np.arange(512) / 256
    wave = (np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 50 * t)).tolist()
    series = spark.createDataFrame([(1, wave), (2, [])], "id long, samples array<double>")
    low = {x["id"]: x["samples"] for x in signal.filtered(series, 256.0, high=20.0).collect()}
    assert low[2] == [] and np.abs(np.array(low[1]) - np.sin(2 * np.pi * 10 * t)).max() < 0.02
    notched = signal.filtered(series.where("id = 1"), 256.0, notch=50.0).first()["samples"]
    assert np.abs(np.array(notched) - np.sin(2 * np.pi * 10 * t)).max() < 0.02
    assert signal.gain(np.array([10.0]), None, 10.0, None, 4, 30)[0] == 0.5
    glass = [optimise.spin_glass(spark, 5, 2.0, seed=3).orderBy("i", "j").collect() for _ in range(2)]
    assert glass[0] == glass[1] and all(abs(x["s"]) <= 2 for x in glass[0]) and len(glass[0]) == 10
    assert optimise.field("linear", 1.0, 2.0) == 0 and optimise.field("exponential", 0.0, 2.0) == 2


def test_shortest_tour(spark):
    places = [(i, j, float(abs(i - j))) for i in range(3) for j in range(3)]
    states = optimise.solve_exact(optimise.tour(spark.createDataFrame(places, "i long, j long, d double"), 3), 9).orderBy("energy").limit(2).collect()
    own = lambda s: [t for v in range(3) for t in range(3) if s >> (3 * v + t) & 1]
    assert sorted(own(x["state"]) for x in states) == [[0, 1, 2], [2, 1, 0]]


def test_neuromatch_edges(spark):
    d = spark.createDataFrame([("abc",), ("",), (None,)], "v string")
    assert [x[0] for x in d.select(neuro.neuromatch(F.col("v"), "")).collect()] == [1.0, 1.0, None]
    assert [x[0] for x in d.select(F.expr(neuro.neuromatch_sql("v", "''"))).collect()] == [1.0, 1.0, None]
    assert [x[0] for x in d.select(neuro.neuromatch(F.col("v"), "abd xyz")).collect()] == [0.0, 0.0, None]


def _plain_network(synapses, currents, steps):
    """One network step by step, synapse by synapse."""
    ids = sorted({x for s in synapses for x in s[:2]} | {n for n, _, _ in currents})
    v, u, last = dict.fromkeys(ids, -65.0), dict.fromkeys(ids, -13.0), {}
    w, g, queue, spikes = [abs(s[2]) for s in synapses], [0.0] * len(synapses), [[] for _ in synapses], []
    for t in range(1, steps + 1):
        drive = {n: sum(c for m, at, c in currents if m == n and at == t) for n in ids}
        for k, (_, post, sign, _) in enumerate(synapses):
            g[k] += sum(x for at, x in queue[k] if at <= t)
            queue[k] = [(at, x) for at, x in queue[k] if at > t]
            g[k] *= np.exp(-1 / (10.0 if sign < 0 else 5.0))
            drive[post] += g[k] * ((-70.0 if sign < 0 else 0.0) - v[post])
        fired = []
        for n in ids:
            for _ in range(2):
                v[n] += 0.5 * (0.04 * v[n] * v[n] + 5 * v[n] + 140 - u[n] + drive[n])
            u[n] += 0.02 * (0.2 * v[n] - u[n])
            if v[n] >= 30:
                v[n], u[n], last[n] = -65.0, u[n] + 8.0, t
                fired.append(n)
        spikes += [(t, n) for n in fired]
        for k, (pre, _, _, delay) in enumerate(synapses):
            if pre in fired:
                queue[k].append((t + delay, w[k]))
        for k, (pre, post, _, _) in enumerate(synapses):
            if post in fired and pre in last and t - last[pre] < 100:
                gap = t - last[pre]
                w[k] = min(1.0, max(0.0, w[k] + (0.005 * np.exp(-gap / 20) if gap > 0 else -0.00525)))
    return spikes, w


def test_spiking_networks(spark):
    synapses = [(1, 2, 0.4, 1), (2, 3, 0.5, 3), (3, 1, -0.6, 2), (1, 3, 0.2, 1)]
    currents = [(n, t, 10.0 if n == 1 else 3.0) for n in (1, 2) for t in range(1, 301)]
    rows = [(k, *s) for k in (7, 8) for s in (synapses if k == 7 else synapses[:1])]
    frame = spark.createDataFrame(rows, "network long, src long, dst long, weight double, delay int")
    driven = spark.createDataFrame([(k, *c) for k in (7, 8) for c in currents], "network long, neuron long, ms long, current double")
    got = learning.spike_network(frame, driven, 300).collect()
    ends = learning.spike_network(frame, driven, 300, weights=True).collect()
    for k, own in ((7, synapses), (8, synapses[:1])):
        spikes, weights = _plain_network(own, currents, 300)
        assert len(spikes) > 5 and sorted((r["ms"], r["neuron"]) for r in got if r["network"] == k) == sorted(spikes)
        assert sorted(abs(r["weight"]) for r in ends if r["network"] == k) == pytest.approx(sorted(weights))

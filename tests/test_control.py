"""Deliveries, and questions to a network by a plain computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import pathway
from lattica.streaming.control import Deliveries


def test_deliveries(spark):
    now = [0.0]
    d = Deliveries(spark, 100, 300, clock=lambda: now[0])
    whole = d.add(spark.range(0, 250, 1, 3))
    assert d.status(whole)["status"] == "waiting"
    assert [len(b) for b in d.fetch(whole)] == [100, 100, 50]
    assert d.status(whole) == {"status": "completed", "rows": 250, "batches": 3, "seconds": 0.0}
    assert not d.cancel(whole) and list(d.fetch(whole)) == []
    part = d.add(spark.range(1000))
    rows = d.fetch(part)
    next(rows)
    assert d.cancel(part) and list(rows) == [] and d.status(part)["status"] == "cancelled" and d.status(part)["rows"] == 100
    slow = d.add(spark.range(1000))
    rows = d.fetch(slow)
    next(rows)
    now[0] = 301.0
    assert list(rows) == [] and d.status(slow)["status"] == "expired"
    unread, empty = d.add(spark.range(5)), d.add(spark.range(0))
    assert list(d.fetch(empty)) == []
    now[0] = 700.0
    assert d.expire() == 1 and d.held == {}
    with pytest.raises(KeyError):
        d.status(unread)
    broken = d.add(spark.range(3).select(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        list(d.fetch(broken))
    assert d.status(broken)["status"] == "failed"


def test_pathway(spark):
    r = random.Random(3)
    nodes = [(n, r.random(), r.random(), r.choice([0, 1, 10, 500])) for n in range(80)]
    links = [(a, b, r.uniform(-1, 1)) for a in range(80) for b in r.sample(range(90), 4)]
    targets, conditions = list(range(0, 100, 2)), [("=", "x", 0.5), (">", "0.2", 0.3), ("<", "?", 0.2), ("LIKE", "a", 0.1), ("IN", "a", 1.0)]
    awake = {n for n, a, *_ in nodes if a > 0.5 and n in targets}
    path = sorted(awake | {b for a, b, w in links if a in awake and w > 0.7})[:20]
    want = {}
    for n, _, s, k in nodes:
        score = 0.5 * (0.9 if s > 0.5 else 0.1) + 0.3 * (0.8 if s > 0.2 else 0) + 0.2 * (0.8 if s < 1 else 0) + 0.1 * 0.7
        if n in path and score > 0.5:
            near = [abs(w) for a, _, w in links if a == n]
            want[n] = round(min(1.0, max(0.0, s + math.log10(k) / 10 + 0.3 * sum(near) / len(near))) if k else 0.0, 9)
    frame = spark.createDataFrame(nodes, "node long, activation double, strength double, accesses long")
    edges = spark.createDataFrame(links, "src long, dst long, weight double")
    found = pathway.pathway(spark.createDataFrame([(t,) for t in targets], "node long"), frame, edges, length=20)
    assert sorted(x["node"] for x in found.collect()) == path
    assert {x["node"]: round(x["confidence"], 9) for x in pathway.matches(found, frame, edges, conditions).collect()} == want and want
    assert pathway.matches(found, frame, edges, []).collect() == []

"""Licenses against the same rules run in Python on every text, without any gate."""

import random
import re

from lattica.llm import licenses

TEXTS = [
    None, "", "!?", "All rights reserved.", "Proprietary and confidential", "Distributed under the BSD", "released under Apache 2.0", "Released under MPL 2.0",
    "released under\nCC0 1.0", "it is in the public\ndomain", "creative\ncommons attribution license 4.0", "Open Software License 3.0", "cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "plain words, provided by nobody", "accepted inside", "published by the python",
]


def scanned(text, rules):
    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    joined = "".join(f" {w}" for w in words) + " "
    spans = lambda p: [(joined[: m.start()].count(" "), joined[: m.end()].count(" ")) for m in p.finditer(joined)]
    found = [(s, e, r) for r, p in rules for s, e in spans(p)]
    rank = lambda s, e, r: (r["priority"], s - e, r["place"])
    beaten = lambda d: any(x[0] <= d[0] and x[1] >= d[1] and (x[2]["priority"] < d[2]["priority"] or x[2]["priority"] == d[2]["priority"] and (x[1] - x[0] > d[1] - d[0] or x[2]["place"] < d[2]["place"])) for x in found)
    kept = sorted((d for d in found if not beaten(d)), key=lambda d: rank(*d))
    base = [label for phrase, label in licenses.BASE for _ in spans(re.compile(f" {phrase}(?= )"))]
    return len(words), len(base), ",".join(sorted({*base, *(r["label"] for *_, r in kept)})), 1.0 if base else max((r["score"] for *_, r in kept), default=0.0)


def test_scan_against_ungated_rules(spark):
    r = random.Random(5)
    rules = [(x, re.compile(x["pattern"])) for x in licenses.rules()]
    own = [r.choice(licenses.expanded(x["pattern"].removesuffix("(?= )"))).title() for x, _ in rules]
    texts = TEXTS + own + [f"Words, {x}\nand {y}." for x, y in zip(own, r.sample(own, len(own)))]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "licenses.*").collect()
    assert {g["doc_id"]: (g["n_words"], g["n_base"], g["labels"], g["score"]) for g in got} == {i: scanned(t, rules) for i, t in enumerate(texts)}


def test_sql_twin_on_texts_of_each_rule(spark):
    import duckdb
    import pandas as pd

    r = random.Random(6)
    own = [r.choice(licenses.expanded(x["pattern"].removesuffix("(?= )"))).title() for x in licenses.rules()]
    texts = TEXTS + own + [" ".join(r.sample(own, 3)) for _ in range(60)] + ["mit license mit license under the MIT license"]
    rows = list(enumerate(texts))
    columns = ("doc_id", "n_words", "n_base", "labels", "score")
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "licenses.*").select(*columns).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(tuple(g) for g in got) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({licenses.SQL})").fetchall())


def test_long_text_of_licenses(spark):
    text = "the MIT license, apache license version 2; GPL 3 or later. " * 20_000
    got = licenses.scan(spark.createDataFrame([(text,)], "text string")).select("licenses.*").first()
    assert (got["n_base"], got["labels"]) == (20_000, "apache-2,mit") and len(got["detections"]) == 40_000


def test_labels_of_texts_without_anchor(spark):
    wanted = {"All rights reserved.": "proprietary", "Distributed under the BSD": "bsd", "released under Apache 2.0": "apache-2", "it is in the public\ndomain": "public-domain", "released under CC0 1.0": "cc0-1.0"}
    got = licenses.scan(spark.createDataFrame([(t,) for t in wanted], "text string")).select("text", "licenses.labels").collect()
    assert {g["text"]: g["labels"] for g in got} == wanted


def test_every_match_holds_a_literal_of_its_rule():
    for heads, rules in licenses.gated_rules():
        for x in rules:
            for m in licenses.expanded(x["pattern"].removesuffix("(?= )")):
                assert any(h in f"{m} " for h in heads) and any(k in f"{m} " for k in x["literals"]), x["name"]


def test_open_software_license_without_osl(spark):
    got = licenses.scan(spark.createDataFrame([("Open Software License 3.0",)], "text string")).select("licenses.labels").first()
    assert got["labels"] == "osl-3.0"

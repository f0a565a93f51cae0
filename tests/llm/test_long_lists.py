"""The join on lists whose members seldom link: all shingles of all documents are heavy."""

import itertools
import random

import pytest

from lattica.llm import jaccard


def test_lists_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_SHARE", 16)
    monkeypatch.setattr(jaccard, "FEW", 200)
    passages = [" ".join(f"p{k}w{i}" for i in range(24)) for k in range(6)]
    chosen = list(itertools.product(itertools.combinations(range(6), 3), range(25)))
    # documents with one passage of three unlike are far under 0.8, so a class is a choice of passages
    rows = [(n, " ".join([passages[k] for k in c] + [f"own{n} last{n}"])) for n, (c, _) in enumerate(chosen)]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {n: 25 * (n // 25) for n in range(len(rows))}


def plain_classes(rows):
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("seed, short", [(2, 2), (4, 12)])
def test_changed_passages(spark, monkeypatch, seed, short):
    """Texts of shared passages with words changed, lost and put in, by brute force."""
    r = random.Random(seed)
    monkeypatch.setattr(jaccard, "LIST_SHARE", 16)
    monkeypatch.setattr(jaccard, "FEW", 200)
    monkeypatch.setattr(jaccard, "SHORT", short)
    passages = [[f"p{p}w{i}" for i in range(r.randrange(8, 60))] for p in range(8)]
    rows = []
    for d in range(400):
        w = sum((passages[p] for p in r.sample(range(8), r.randrange(1, 5))), [])
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            k = r.randrange(len(w))
            w[k : k + r.randrange(3)] = r.choice([[], [f"x{r.randrange(30)}"], [f"y{d}"]])
        rows.append((d, " ".join(w)))
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == plain_classes(rows)

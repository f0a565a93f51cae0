"""Odd inputs for every operator: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lattica.llm import common, jaccard, language, licenses, ogg, packing, pieces, pii, quality, tokenids, toxicity

SCHEMA = "doc_id long, text string, lang string, quality string, pii string, licenses string, key long, n long"


@pytest.fixture(scope="module")
def odd(spark):
    base = "the quick brown fox jumps over the lazy dog and " * 12
    texts = [None, "", " \n\t ", "one", "a@b.co and +1 (743) 555-3824", base, base, base + "tail", "word " * 20_000, "\u0000x", "é中文 " * 30, "under the MIT License"]
    rows = [(i if i else None, t, None, "q", "p", "l", 1, 2) for i, t in enumerate(texts)] + [(5, base, "en", "q", "p", "l", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


RUNS = {
    "packing": packing.pack,
    "pii": lambda d: pii.sanitise(d, into="own"),
    "ogg": lambda d: ogg.decoded(ogg.encoded(d)),
    "licenses": lambda d: licenses.scan(d, into="own"),
    "pieces": lambda d: pieces.decoded(pieces.encoded(d, public_tokenizers.path("piece_bpe_32k.model")), public_tokenizers.path("piece_bpe_32k.model")),
    "language": lambda d: language.labelled(d, language.trained(d)),
    "jaccard": jaccard.classes,
    "toxicity": lambda d: toxicity.scored(d, None, 0.1),
    "quality": lambda d: quality.judge(d, into="own"),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(odd, none, name):
    assert len(RUNS[name](odd).collect()) == odd.count()
    assert RUNS[name](none).collect() == []


def test_token_files(spark, odd, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = tokenids.read(tokenids.write(odd, str(tmp_path / "a"), path), str(tmp_path / "a")).collect()
    assert len(rows) == odd.count() and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    assert tokenids.read(tokenids.write(none, str(tmp_path / "b"), path), str(tmp_path / "b")).collect() == []
    e = tokenids.Encoder(path)
    r = random.Random(1)
    for _ in range(500):
        x = "".join(r.choice([" ", "  ", "\n", "a", "the", "'s", "é", "<|endoftext|>", "中", " x", " "]) for _ in range(r.randint(0, 9)))
        assert np.frombuffer(e([x])[0], "<u2").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_jaccard_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = r.choices(vocabulary, k=30)
    rows = []
    for i in range(260):
        base = r.choices(vocabulary, k=r.choice([3, 6, 9, 20, 60])) if i % 3 or not rows else list(r.choice(rows)[1].split())
        if base and i % 3 == 0:
            base[r.randrange(len(base))] = r.choice(vocabulary)
        rows.append((i, " ".join(base + (passage if i % 5 == 0 else []))))
    rows += [(900 + i, rows[0][1].upper()) for i in range(5)] + [(990, None), (991, "  ")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))

    sets, up = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    for short, hubs, few, heavy, edges in ((12, 2, 100_000, 4, 15_000), (2, 1, 1, 2, 1)):
        for k, v in (("SHORT", short), ("HUBS", hubs), ("FEW", few), ("HEAVY_FROM", heavy), ("LIST_SHARE", 8 if edges == 1 else 512), ("COUNTED_TOKENS", 2_000)):
            monkeypatch.setattr(jaccard, k, v)
        monkeypatch.setattr(common, "SMALL_EDGES", edges)
        monkeypatch.setattr(common, "SHARE", 3 if edges == 1 else 2_000)
        found = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {i: (top(i), len(sets[i])) for i, _ in rows}


def test_names_of_sets_that_share_64_bits(spark, monkeypatch):
    whole = jaccard.fingerprint
    monkeypatch.setattr(jaccard, "fingerprint", lambda s, odd=jaccard._ODD: 7 if odd == jaccard._ODD else whole(s, odd))
    texts = [f"a{i % 3} b{i % 3} c{i % 3} d{i % 3} e{i % 3} f{i % 3}" for i in range(9)]
    signed = jaccard.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len({(r["fp"], r["other"]) for r in signed.collect()}) == 3


def test_words_of_like_structure_have_hashes_of_their_own():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    own = jaccard.Shingler()([a, b, a + " x", "x " + a, "ab", "ba"])
    assert len({int(s[0]) for s in own}) == 6 and all(len(s) == 1 for s in own)


def test_one_of_each_keeps_rows_of_other_classes(spark):
    base, other = "one two three four five six seven eight nine ten " * 3, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [(1, base, 9), (1, other, 9), (2, base, 9), (None, other, 9), (None, "x y z", 9), (None, "x y z", 9), (4, None, 9), (4, " ", 9), (5, "x y z", 9), (6, "x y z", 9)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, set_0 int"))
    assert kept.columns == ["doc_id", "text", "set_0"]
    assert sorted(map(str, ((r[0], r[1]) for r in kept.collect()))) == sorted(map(str, [(1, base), (1, other), (4, None), (4, " "), (5, "x y z")]))
    assert jaccard.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bounds_against_brute_force():
    r = random.Random(2)
    cost = lambda L, c, b: sum(n * (min(x for x in b if x >= v) - v) for v, n in zip(L, c))
    for _ in range(100):
        lengths = sorted(r.sample(range(1, 40), r.randint(1, 8)))
        counts, k = [r.randint(1, 20) for _ in lengths], r.randint(1, 4)
        own = packing.bounds(lengths, counts, k)
        assert cost(lengths, counts, own) == min(cost(lengths, counts, x) for j in range(1, min(k, len(lengths)) + 1) for x in itertools.combinations(lengths, j) if x[-1] == lengths[-1])


def test_viterbi_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(10):
        scores, docs = r.normal(size=(20, 3)).astype(np.float32), [r.integers(0, 20, size=r.integers(0, 6)) for _ in range(5)]
        for d, p in zip(docs, language.viterbi(scores, docs, 0.7)):
            value = lambda q: sum(scores[a, b] for a, b in zip(d, q)) - 0.7 * sum(a != b for a, b in zip(q, q[1:]))  # noqa: E731, B023
            assert abs(value(p) - max(map(value, itertools.product(range(3), repeat=len(d))))) < 1e-5


def test_segmentation_against_brute_force():
    own = pieces.Pieces([(1, "a", -1.0), (2, "ab", -1.5), (3, "b", -1.0), (4, "bc", -0.7), (5, "▁", -1.0), (6, "▁a", -1.2)], {b: 100 + b for b in range(256)})
    worth = {"a": -1.0, "ab": -1.5, "b": -1.0, "bc": -0.7, "▁": -1.0, "▁a": -1.2}

    def best(s):
        return 0 if not s else max((worth[s[:k]] if s[:k] in worth else own.unknown if k == 1 else -1e9) + best(s[k:]) for k in range(1, len(s) + 1))

    for n in range(1, 6):
        for s in map("".join, itertools.product("abc▁", repeat=n)):
            ids, total, k = own.best(s), 0.0, 0
            while k < len(ids):
                if ids[k] < 100:
                    total, k = total + worth[own.text[ids[k]]], k + 1
                else:
                    total, k = total + own.unknown, k + 1
            assert abs(total - best(s)) < 1e-9
    for text in ("", "a b", " x▁y ", "\U0001f600"):
        assert own.decode(own.encode(text)) == text


def test_ogg_pages():
    payload = bytes(range(256)) * 600
    media = ogg.encode(payload)
    assert ogg.decode(media)[0] == payload
    for segments in (1, 20, 21, 22, 255):
        some = ogg.encode(payload, segments)
        assert ogg.decode(some) == ogg.decode(media) and (segments == 21 or any(flags & 1 for *_, flags, _, _ in ogg.pages(some)))
    with pytest.raises(ValueError):
        ogg.decode(media[:100] + b"x" + media[101:])
    # a packet over two pages
    whole = lambda sequence, granule, packet, flags: ogg.page(7, sequence, granule, ogg.lacing_of([packet]), packet, flags)
    one = whole(0, 0, b"head", 2)
    lacing = b"\xff" * 2
    body = b"z" * 510
    first = b"OggS\0\0" + (-1).to_bytes(8, "little", signed=True) + (7).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\0\0\0\0" + bytes([2]) + lacing + body
    first = first[:22] + ogg.checksum(first).to_bytes(4, "little") + first[26:]
    last = whole(2, 600, b"tail", 5)
    assert ogg.demultiplex(one + first + last)[7][1] == (body + b"tail", 600)


def test_gradient():
    words, ids = ["aa", "bb", "cc", "idiot"], np.array([[0, 1, 2], [3, 3, 1], [2, 0, 0]])
    mask, y = np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1]], bool), np.array([1.0, 0, 1], np.float32)
    net = toxicity.Network({"aa": 1, "bb": 2, "idiot": 3}, np.zeros(3, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradient(words, ids, mask, y, np.ones(3, np.float32))

    def loss():
        q = toxicity._sigmoid(net.logits(net.projected(words).astype(np.float64), ids, mask))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    for k, v in g.items():
        at = np.unravel_index(np.argmax(np.abs(v)), v.shape)
        net.p[k][at] += 1e-2
        up = loss()
        net.p[k][at] -= 2e-2
        down = loss()
        net.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - v[at]) < 1e-4


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(documents, *toxicity.trained(documents, labels)).collect()}
    held = [(scores[r["doc_id"]] >= 0.5) == bool(r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.9

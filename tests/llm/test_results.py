"""Each query's whole result on odd rows against a plain computation of the same thing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from lattica.llm import common, language, ogg, packing, pieces, pii, quality, tokenids, toxicity

R = random.Random(11)
WORDS = "the of and river stone green light water house when small little over under again bright morning".split()
PROSE = [" ".join(R.choice(WORDS) for _ in range(n)) for n in (60, 80, 120, 64, 90)]
PERSONAL = "mail a.b+c@ex-ample.co.uk or x@y (no dot), 10.0.0.255 and 10.0.0.256, 4111 1111 1111 1111, 4111-1111-1111-1112, +1 (743) 555-3824, +12 34, é a@b.co中"
TEXTS = [None, "", " \n\t ", "one", PERSONAL, PERSONAL + " " + PERSONAL, *PROSE, PROSE[0], PROSE[1] + " again", "word " * 20_000, "\u0000x", "é中文 " * 30, "½ ²", "हिन्दी भाषा", " ▁ a  b ", "a@b.co " * 300, " " * 5_000 + "x"]
ROWS = [(i if i != 3 else None, t, "en" if i % 2 else None, "web") for i, t in enumerate(TEXTS)] + [(6, PROSE[0], "en", "web"), (6, PROSE[0], "en", "web")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    pd.DataFrame({"doc_id": pd.array([r[0] for r in ROWS], dtype="Int64"), "text": [r[1] for r in ROWS], "lang": [r[2] for r in ROWS], "source": [r[3] for r in ROWS], "n_chars": [len(r[1] or "") for r in ROWS]}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": [6, 7, 8, 9], "quality": [1, 1, 0, 1], "toxic": [0, 0, 0, 0]}).to_parquet(d / "labels.parquet")
    return str(d)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_packing(spark, folder):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS]
    histogram = Counter(n for n in words if n)
    edges = [0, *packing.bounds(sorted(histogram), [histogram[n] for n in sorted(histogram)], packing.BUCKETS)]
    rank, expected = Counter(), []
    for n, key, _ in sorted((n, (r[0] is not None, r[0] or 0), i) for i, (n, r) in enumerate(zip(words, ROWS))):
        b = next(i for i, e in enumerate(edges) if n <= e)
        size = max(1, packing.BUDGET // max(1, edges[b]))
        expected.append((key[1] if key[0] else None, n, b, edges[b], rank[b] // size, rank[b] % size, edges[b] - n))
        rank[b] += 1
    assert as_rows(packing.query(spark, folder), "doc_id", "n_words", "bucket", "bucket_words", "batch", "place", "padding") == sorted(expected, key=str)


def test_token_ids(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in ROWS]
    digest = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    got = tokenids.query(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(r[0]), len(x), digest(x)) for r, x in zip(ROWS, ids))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert [x for x in order if x is not None] == sorted(x for x in order if x is not None)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    """Base spans by the plain patterns of the contract."""
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data(spark, folder):
    got = sorted(pii.query(spark, folder).collect(), key=lambda r: (str(r["doc_id"]), r["spans"]))
    wanted = []
    for r in ROWS:
        spans = base(r[1] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        wanted.append((str(r[0]), joined, *(sum(k == s[0] for s in spans) for k in pii.KINDS)))
    for r, (i, joined, *n) in zip(got, sorted(wanted, key=lambda w: (w[0], w[1]))):
        assert (str(r["doc_id"]), [r[f"n_{k}"] for k in pii.KINDS]) == (i, n)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


#: A corpus in which `patient` stands beside addresses alone, `reach` mostly, `plain` words everywhere.
PLANTED = [f"plain{i % 7} words stand here far from it patient user{i}@clinic.org and plain{i % 5} more words follow on" for i in range(30)] + [f"reach user{i}@mail.net {'plain1 plain2 ' * 5}" for i in range(20)] + ["reach plain3 plain4 plain2"] * 2 + ["plain1 plain5 mail stands and follow on words " * 20] * 8


def disclosed(texts, at):
    """Terms and their disclosure, word place by word place."""
    places, support, near, total = Counter(), defaultdict(set), defaultdict(Counter), Counter()
    for t in texts:
        low, spans = t.lower(), sorted((a, b, k) for k, a, b in base(t))
        tokens, pos = [], 0
        for a, b, k in [*spans, (len(t), len(t), None)]:
            tokens += [(m[0], None) for m in re.finditer(r"[^\W_]+", low[pos:a])]
            if k:
                tokens.append((low[a:b], k))
            pos = b
        for i, (w, k) in enumerate(tokens):
            if k:
                continue
            places[w] += 1
            around = {(x, y) for x, y in tokens[max(0, i - at.reach) : i + at.reach + 1] if y}
            for kind in {y for _, y in around}:
                near[kind][w] += 1
                total[kind] += 1
            support[w] |= around
    n, out = sum(places.values()), {}
    for kind, by in near.items():
        for w, c in by.items():
            value = 1 - math.log2(c / places[w]) / math.log2(total[kind] / n)
            if len(support[w]) >= at.support and value >= at.generalise_at and value > out.get(w, ("", 0))[1]:
                out[w] = (kind, value)
    return out


def test_disclosing_terms_both_ways(spark):
    at = pii.Thresholds(remove_at=0.97, generalise_at=0.75)
    terms = disclosed(PLANTED, at)
    assert terms["patient"][1] == 1 and 0.75 <= terms["reach"][1] < 0.97 and not any(w.startswith("plain") for w in terms)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(PLANTED)], "doc_id long, text string, whole int, k1 int")
    results = []
    for inline in (1000, 0):
        some = pii.sanitise(docs, at=pii.Thresholds(remove_at=0.97, generalise_at=0.75, inline_terms=inline))
        assert some.columns == ["doc_id", "text", "whole", "k1", "pii"]
        results.append(sorted((r["doc_id"], [(s["start"], s["end"], s["kind"]) for s in r["pii"]["terms"]], r["pii"]["text"]) for r in some.collect()))
    assert results[0] == results[1]
    for i, spans, clean in results[0]:
        text, taken = PLANTED[i], base(PLANTED[i])
        wanted = [(m.start(), m.end(), ("drop-" if terms[w][1] >= 0.97 else "term-") + terms[w][0]) for m in re.finditer(r"[^\W_]+", text) if (w := m[0].lower()) in terms and not any(a < m.end() and m.start() < b for _, a, b in taken)]
        assert sorted(spans) == sorted(wanted)
        assert "patient" not in clean and "reach" not in clean and "@" not in clean and ("plain" in clean)
        assert ("[EMAIL TERM]" in clean) == any(k == "term-email" for *_, k in wanted)


def test_long_texts_of_personal_data(spark):
    text = "a@b.co x " * 30_000 + "word " * 100_000
    r = pii.sanitise(spark.createDataFrame([(text,)], "text string")).select("pii.*").first()
    assert len(r["base"]) == 30_000 and r["text"] == "[EMAIL] x " * 30_000 + "word " * 100_000


def test_long_runs_of_blanks(spark):
    text = "x" + " " * 400_000 + "y" + "\t" * 400_000
    assert quality.judge(spark.createDataFrame([(text,)], "text string")).select("quality.m.n_words").first()[0] == 2


def test_media(spark, folder):
    got = sorted(ogg.query(spark, folder).collect(), key=lambda r: (str(r["doc_id"]), r["payload_sha256"]))
    wanted = []
    for r in ROWS:
        raw = (r[1] or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wanted.append((str(r[0]), hashlib.sha256(whole).hexdigest(), len(raw), len(whole), zlib.crc32(whole[-64:])))
    assert [(str(r["doc_id"]), r["payload_sha256"], r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in got] == sorted(wanted)
    by = defaultdict(set)
    for r in got:
        by[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by.values()) and all(r["feature"] for r in got)


def test_pieces(spark, folder):
    own = pieces.Pieces.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda ids: zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
    got = sorted((str(r["doc_id"]), r["n_pieces"], r["ids_crc32"], r["text_sha256"]) for r in pieces.query(spark, folder).collect())
    ids = [own.encode(r[1]).tolist() for r in ROWS]
    assert got == sorted((str(r[0]), len(x), digest(x), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, x in zip(ROWS, ids))
    worth = {p: own.auto.get(p)[2] for p in own.text.values() if p and p in own.auto}
    for t in [w for r in ROWS[3:12] for w in (r[1] or "").split()[:12]]:
        s = "▁" + t
        best = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                best[j] = max(best[j], best[i] + (worth[s[i:j]] if s[i:j] in worth else own.unknown if j == i + 1 else -math.inf))
        found, k, total = own.best(s), 0, 0.0
        while k < len(found):
            if found[k] in own.bytes:
                size = len(bytes([own.bytes[found[k]]])) and {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}[max(1, f"{own.bytes[found[k]]:08b}".index("0"))]
                total, k = total + own.unknown, k + size
            else:
                total, k = total + worth[own.text[found[k]]], k + 1
        assert abs(total - best[-1]) < 1e-6, t


def test_language(spark, folder):
    got = language.query(spark, folder).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    for i, t in enumerate(TEXTS):
        if i != 3:
            letters = any(c.isalpha() for c in t or "")
            assert all(r["lang_pred"] == ("en" if letters else "und") for r in by[i]), (i, t)
    assert language.words_of("½ ² हिन्दी a1b_c É") == ["हिन्दी", "a", "b", "c", "é"]
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in language.query(spark, sf).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(held) / len(held) > 0.97


def test_toxicity_on_odd_rows(spark, folder):
    sf = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net, prior = toxicity.trained(documents, labels)
    assert net is not None
    odd = spark.read.parquet(f"{folder}/documents.parquet")
    got = defaultdict(set)
    for r in toxicity.scored(odd, net, prior).collect():
        assert 0 <= r["score"] <= 1
        got[r["doc_id"]].add(r["score"])
    assert got[0] == got[1] == got[2] == {net.prior} and net.prior < 0.5 and len(got[6]) == 1
    scorer = toxicity.Scorer(net)
    for i, t in enumerate(TEXTS):
        words = toxicity.words_of(t)
        if i != 3 and words and len(words) < 200:
            best = max(scorer.highest([words[s : s + toxicity.WINDOW]])[0][0] for s in toxicity.window_starts(len(words)))
            assert abs(1 / (1 + math.exp(-net.scale * (best - net.shift))) - next(iter(got[i]))) < 1e-4
    kept = toxicity.keep_clean(odd, net, prior)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, s in got.items() for _ in [r for r in ROWS if r[0] == i] if max(s) < 0.5)


def test_scorer_keeps_words_in_place(monkeypatch):
    words = [f"word{i}" for i in range(900)]
    net = toxicity.Network({w: i + 1 for i, w in enumerate(words[::2])}, np.zeros(450, np.float32))
    monkeypatch.setattr(toxicity, "_CACHE", 400)
    scorer, alone = toxicity.Scorer(net), net.projected(words)
    first = scorer.ids([words[:100]])
    held = scorer.gates
    for k in range(0, 900, 100):  # past the cache words are forgotten and learned anew
        ids = scorer.ids([words[k : k + 100], [], words[k : k + 50]])
        assert np.allclose(scorer.gates[ids[0]], alone[k : k + 100], atol=1e-5) and ids[2].tolist() == ids[0][:50].tolist()
        assert scorer.gates is held, "kept words were copied"
    assert len(set(first[0].tolist())) == 100
    many = scorer.ids([[f"other{i}" for i in range(2000)]])[0]  # more than the cache at once
    assert np.allclose(scorer.gates[many], net.projected([f"other{i}" for i in range(2000)]), atol=1e-5)


def test_pipeline_hands_workers_small_batches(spark, folder):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "if(id < 2990, 'a b c', repeat('long text ', 200000)) as text")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        for k in keys:
            spark.conf.unset(k)
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["n"] for r in got) <= common.BATCH_ROWS
        assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + 3_000_000  # up to the row that goes beyond
    for k, less in zip(keys, ("7", "1m")):
        spark.conf.set(k, less)
        common.small_batches(spark)
        assert spark.conf.get(k) == less
        spark.conf.unset(k)


def test_pipeline(spark, folder):
    good = {r["doc_id"] for r in quality.query(spark, folder).where("kept").collect()}
    assert good == {i for i, t in enumerate(TEXTS) if t in PROSE or t == PROSE[1] + " again"}
    # all labels are clean, so no network is fitted; copies and near copies go, the least id stays
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["n_words"]) for r in got.collect()) == [(i, len(t.split())) for i, t in enumerate(TEXTS) if t in PROSE and i < 11]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert name == "packing" or stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).collect() == []
    clashing = docs.selectExpr("*", "1 as pii", "2 as quality", "3 as set", "4 as whole", "5 as base", "6 as key", "7 as fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns and {r["pii"] for r in out.collect()} == {1}

"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Each word enters as the embedding of the word beside the mean embedding of its character 3- to 5-grams. Windows of WINDOW words,
one every STRIDE, go through a forward and a backward gated recurrent layer; attention pools the states into one logit.
A text's score is that of its highest window, all windows of the whole text being scored.

Training is multiple-instance learning on a bounded sample of labelled texts (SAMPLE per class, the smallest hashes of the
id): a toxic text teaches by its highest window, a clean one by its highest and a random one. Sample and network have a
fixed size, so training costs the same at any input; scoring is one map-only pass, batch by batch.

Defined cases: null text counts as empty; a text without words gets the prior, the share of toxic labels, below 0.5;
repeated rows get equal scores; without both labels in the sample all texts get the prior; an empty table gives an
empty result; extra columns play no part, and `keep_clean` passes them through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, gram_cells, slices, tidy

WINDOW, STRIDE = 48, 32
#: Texts per class that the network is fitted on, at most; words with an embedding of their own; cells of character grams.
SAMPLE, VOCABULARY, GRAMS = 1000, 20_000, 1 << 16
DIM, HIDDEN = 8, 8
_WORD = re.compile(r"\w+")
_CACHE = 150_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_starts(n: int) -> range:
    """Starts of the windows of n words: every word is in one, and neighbours overlap."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the pass forward, and its gradient."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, gram_odds: np.ndarray | float = 0.0, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": small(len(vocabulary) + 1, DIM) * 0.2, "char": small(GRAMS, DIM) * 0.2, "wa": small(2 * HIDDEN, HIDDEN), "va": small(HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.p["word"][1:, 0] = odds
        self.p["char"][:, 0] = 3 * gram_odds
        for d in "fb":
            self.p |= {f"w{d}": small(2 * DIM, 3 * HIDDEN), f"u{d}": small(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.1

    def inputs(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Word ids, gram cells of all words end to end, and where each word's begin."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        return ids, *gram_cells(words, 3, 5, GRAMS)

    def embedded(self, ids, cells, at) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][cells], at[:-1]) / np.diff(at)[:, None]
        return np.concatenate([self.p["word"][ids], chars], axis=1)

    def projected(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        x = self.embedded(*self.inputs(words))
        return np.concatenate([x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"], axis=1).astype(np.float32)

    def layer(self, d: str, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (length, windows, HIDDEN) of one direction; ids (length, windows) are rows of gates."""
        n, h = HIDDEN, np.zeros((ids.shape[1], HIDDEN), np.float32)
        out = np.empty((*ids.shape, n), np.float32)
        u, offset = self.p[f"u{d}"], 0 if d == "f" else 3 * n
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            x = gates[ids[t], offset : offset + 3 * n]
            a = h @ u
            zr = x[:, : 2 * n] + a[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(np.minimum(zr, 30, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
            new = c + z * (h - c)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, a[:, 2 * n :], m))
            h = new if m.all() else np.where(m, new, h)
            out[t] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        k = np.tanh(states @ self.p["wa"])
        e = np.where(mask, k @ self.p["va"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        return k, w, (states * w[:, :, None]).sum(0)

    def logits(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.layer(d, gates, ids, mask) for d in "fb"], axis=2)
        return self.pooled(states, mask)[2] @ self.p["out"] + self.p["bias"][0]

    def gradient(self, words: list[str], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy; ids are places in words."""
        p, n = self.p, HIDDEN
        own = self.inputs(words)
        x = self.embedded(*own)
        gates = np.concatenate([x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"], axis=1)
        kept = {"f": [], "b": []}
        states = np.concatenate([self.layer(d, gates, ids, mask, kept[d]) for d in "fb"], axis=2)
        k, w, pool = self.pooled(states, mask)
        dl = (_sigmoid(pool @ p["out"] + p["bias"][0]) - y) * weight / len(y)
        g = {"out": pool.T @ dl, "bias": np.array([dl.sum()])}
        dpool = dl[:, None] * p["out"]
        ds = w[:, :, None] * dpool
        dw = (states * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dk = de[:, :, None] * p["va"] * (1 - k * k)
        g["va"] = np.tensordot(de, k, ([0, 1], [0, 1]))
        g["wa"] = np.tensordot(states, dk, ([0, 1], [0, 1]))
        ds = ds + dk @ p["wa"].T
        dgates = np.zeros_like(gates)
        for i, d in enumerate("fb"):
            dh, gu = np.zeros((ids.shape[1], n), np.float32), np.zeros_like(p[f"u{d}"])
            every = np.zeros((*ids.shape, 3 * n), np.float32)
            for t, h, z, r, c, an, m in reversed(kept[d]):
                dh = dh + ds[t][:, i * n : (i + 1) * n]
                dnew = np.where(m, dh, 0)
                dc = dnew * (1 - z) * (1 - c * c)
                da = np.concatenate([dnew * (h - c) * z * (1 - z), dc * an * r * (1 - r), dc * r], axis=1)
                every[t, :, : 2 * n], every[t, :, 2 * n :] = da[:, : 2 * n], dc
                gu += h.T @ da
                dh = np.where(m, dnew * z, dh) + da @ p[f"u{d}"].T
            g[f"u{d}"] = gu
            for j in range(3 * n):
                dgates[:, i * 3 * n + j] = np.bincount(ids.ravel(), every[:, :, j].ravel(), len(words))
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            part = dgates[:, i * 3 * n : (i + 1) * 3 * n]
            g[f"w{d}"], g[f"c{d}"] = x.T @ part, part.sum(0)
            dx += part @ p[f"w{d}"].T
        word_ids, cells, at = own
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        per = np.diff(at)
        spread = np.repeat(dx[:, DIM:] / per[:, None], per, axis=0)
        for j in range(DIM):
            g["word"][:, j] = np.bincount(word_ids, dx[:, j], len(p["word"]))
            g["char"][:, j] = np.bincount(cells, spread[:, j], GRAMS)
        return g


def _windows(ids: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) ids and their mask."""
    starts = np.asarray(window_starts(len(ids)))
    at = starts[:, None] + np.arange(WINDOW)
    mask = at < len(ids)
    return np.where(mask, ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else pad, pad), mask


class Scorer:
    """Scores of texts by a network; what words add to the gates is kept between batches, up to _CACHE words."""

    def __init__(self, net: Network):
        self.net, self.seen = net, {}
        self.gates = np.empty((0, 6 * HIDDEN), np.float32)  # rows beyond those of `seen` are room that the system gives when it is filled

    def ids(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.seen) > _CACHE:
            self.seen = {}
        new = list({w for ws in docs for w in ws if w not in self.seen})
        held = len(self.seen)
        if held + len(new) > len(self.gates):
            more = np.empty((max(_CACHE, held) + len(new), 6 * HIDDEN), np.float32)
            more[:held] = self.gates[:held]
            self.gates = more
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            self.gates[held + k : held + k + len(some)] = self.net.projected(some)
        self.seen.update(zip(new, range(held, held + len(new))))
        seen = self.seen
        return [np.fromiter((seen[w] for w in ws), dtype=np.int32, count=len(ws)) for ws in docs]

    def highest(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit of each text (-inf without words) and that window's number."""
        best, place = np.full(len(docs), -np.inf), np.zeros(len(docs), dtype=np.int64)
        ids, masks, own, number = [], [], [], []

        def flush():
            i, m = np.concatenate(ids).T.copy(), np.concatenate(masks).T.copy()
            o, w = np.concatenate(own), np.concatenate(number)
            for k in range(0, len(o), 1024):
                some = slice(k, k + 1024)
                lo = self.net.logits(self.gates, i[:, some], m[:, some])
                for d, x, v in zip(o[some].tolist(), w[some].tolist(), lo.tolist()):
                    if v > best[d]:
                        best[d], place[d] = v, x
            for x in (ids, masks, own, number):
                x.clear()

        held = 0
        for d, one in enumerate(self.ids(docs)):
            if not len(one):
                continue
            i, m = _windows(one)
            for a, x in ((ids, i), (masks, m), (own, np.full(len(i), d)), (number, np.arange(len(i)))):
                a.append(x)
            held += len(i)
            if held >= 4096:
                flush()
                held = 0
        if own:
            flush()
        return best, place

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        part, size, begin = [], 0, 0
        for k, t in enumerate([*texts, None]):
            if k == len(texts) or (part and size > 500_000):
                best = self.highest(part)[0] if part else np.empty(0)
                out[begin:k] = np.where(np.isfinite(best), _sigmoid(self.net.scale * (best - self.net.shift)), self.net.prior)
                part, size, begin = [], 0, k
            if k < len(texts):
                part.append(words_of(t))
                size += len(t or "")
        return out


def fit(texts: list[str], labels: list[int], rounds: int = 7, prior: float = 0.1, seed: int = 7) -> Network | None:
    """A network of labelled texts; None without both labels. prior: the share of toxic texts among all labelled ones."""
    docs, y = [words_of(t) for t in texts], np.array(labels, dtype=np.float32)
    use = [i for i, d in enumerate(docs) if d]
    docs, y = [docs[i] for i in use], y[use]
    if len(set(y.tolist())) < 2:
        return None
    counts: dict[str, list[int]] = {}
    for d, one in zip(docs, y):
        for w in set(d):
            counts.setdefault(w, [0, 0])[int(one)] += 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted((w for w, c in counts.items() if sum(c) > 1), key=lambda w: (-sum(counts[w]), w))[:VOCABULARY])}
    clean, toxic = (y == 0).sum(), (y == 1).sum()
    grams = np.zeros((GRAMS, 2))
    for d, one in zip(docs, y):
        grams[np.unique(gram_cells(list(set(d)), 3, 5, GRAMS)[0]), int(one)] += 1

    def odds(seen: np.ndarray) -> np.ndarray:
        """Log odds of toxic texts among those that have something, drawn to 0 by their deviation."""
        ratio = np.log((seen[:, 1] + 0.5) / (toxic + 1)) - np.log((seen[:, 0] + 0.5) / (clean + 1))
        deviation = np.sqrt(1 / (seen[:, 1] + 0.5) + 1 / (seen[:, 0] + 0.5))
        return np.clip(np.sign(ratio) * np.maximum(0, np.abs(ratio) - 1.5 * deviation), -3, 3).astype(np.float32)

    net = Network(vocabulary, odds(np.array([counts[w] for w in vocabulary], dtype=np.float64).reshape(-1, 2)), odds(grams), seed)
    rng = np.random.default_rng(seed)
    first, second, step = {}, {}, 0
    for turn in range(rounds):
        scorer = Scorer(net)
        place = scorer.highest(docs)[1] if turn else np.array([rng.integers(len(window_starts(len(d)))) for d in docs])
        jobs = [(i, int(place[i])) for i in range(len(docs))] + [(i, int(rng.integers(len(window_starts(len(docs[i])))))) for i in range(len(docs)) if y[i] == 0]
        rng.shuffle(jobs)
        share = len(jobs) / max(1, 2 * sum(y[i] == 1 for i, _ in jobs))
        for _ in range(max(1, 12 // max(1, len(jobs) // 96))):
            for k in range(0, len(jobs), 96):
                some = jobs[k : k + 96]
                cut = [docs[i][STRIDE * w : STRIDE * w + WINDOW] for i, w in some]
                words = sorted({w for c in cut for w in c})
                known = {w: j for j, w in enumerate(words)}
                ids = np.array([[known[w] for w in c] + [0] * (WINDOW - len(c)) for c in cut]).T
                mask = np.array([[True] * len(c) + [False] * (WINDOW - len(c)) for c in cut]).T
                goal = y[[i for i, _ in some]]
                g = net.gradient(words, ids, mask, goal, np.where(goal == 1, min(share, 5.0), 1.0).astype(np.float32))
                step += 1
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for name, v in g.items():
                    v = v * min(1.0, 1.0 / (size + 1e-9))
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * v
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * v * v
                    net.p[name] = (net.p[name] - 0.02 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    best = Scorer(net).highest(docs)[0]
    by = np.argsort(best)
    weight = np.where(y == 1, prior / toxic, (1 - prior) / clean)[by]
    # the cut between two scores that mislabels least: toxic texts below it and clean ones above it
    wrong = np.concatenate([[0], np.cumsum(np.where(y[by] == 1, weight, 0))]) + np.concatenate([np.cumsum(np.where(y[by] == 0, weight, 0)[::-1])[::-1], [0]])
    lows = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = int(lows[len(lows) // 2])
    edge = np.concatenate([[best[by[0]] - 1], best[by], [best[by[-1]] + 1]])
    net.shift, net.prior = float((edge[at] + edge[at + 1]) / 2), float(min(prior, 0.49))
    return net


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network | None, float]:
    """A network fitted on at most `sample` texts of each label, from rows outside the held-out fifth; and the share of toxic ones."""
    usable = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    chosen = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").dropDuplicates(["doc_id"])  # at most 2 * sample rows
    rows = sorted(picked.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] or "" for r in rows], [r["toxic"] for r in rows], prior=prior), prior


def scored(docs: DataFrame, net: Network | None, prior: float, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""

    def score(batches):
        scorer = Scorer(net) if net else None
        for c in slices(batches):
            s = scorer.scores(c.column(1).to_pylist()) if scorer else np.full(len(c), min(prior, 0.49))
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text").mapInArrow(tidy(score), "doc_id long, score double")


def keep_clean(docs: DataFrame, net: Network | None, prior: float) -> DataFrame:
    """The rows of docs with a score below 0.5, with their columns."""

    schema, place = docs.schema, docs.columns.index("text")

    def clean(batches):
        scorer = Scorer(net) if net else None
        for c in slices(batches):
            yield c.filter(pa.array(scorer.scores(c.column(place).to_pylist()) < 0.5)) if scorer else c

    return docs.mapInArrow(tidy(clean), schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    s = scored(documents, *trained(documents, labels))
    return s.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's script leaves the languages that were seen in that script. Each of them scores the word by its character grams (a
naive Bayes model of hashed 1- to 4-grams). Viterbi over the words of the whole text, with a penalty for each switch,
gives the best sequence of labels, hence spans of mixed-language texts; the language of most letters is the text's.

The model is fitted on a bounded sample (SAMPLE texts a language at most, those of the smallest hashes of the id, outside
the held-out quarter) and has a fixed size. Prediction is one map-only pass; texts of a batch go through Viterbi in step.

Defined cases: null, empty and letterless texts (no code point of a letter category) are `und` with score 0; ties go to the language that sorts first;
repeated rows get equal results; without a labelled row all texts are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, gram_cells, slices, tidy

SAMPLE, CELLS, PENALTY = 600, 1 << 16, 8.0


def _ranges(*categories: str) -> str:
    """A character class body of the code points of some Unicode categories."""
    held = [unicodedata.category(chr(c))[0] in categories for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(held)) if held[c] and not (c and held[c - 1])], [c for c in range(len(held)) if held[c] and not (c + 1 < len(held) and held[c + 1])]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(*edges))


#: Runs of letters with the marks on them; of ASCII texts, letters.
_ASCII_WORD = re.compile("[a-z]+")


@cache
def _word() -> re.Pattern:
    letters = _ranges("L")
    return re.compile(f"[{letters}][{letters}{_ranges('M')}]*")


_CACHE = 100_000

# First code points of script ranges; what stands between two of them belongs to the former.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"),
)
_STARTS = [s for s, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (_ASCII_WORD if low.isascii() else _word()).findall(low)


def cells_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return gram_cells(words, 1, 4, CELLS)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        counts, scripts = np.full((CELLS, len(self.langs)), 0.2), {}
        words = [Counter() for _ in self.langs]
        for t, lang in zip(texts, langs):
            words[self.langs.index(lang)].update(words_of(t))
        for k, c in enumerate(words):
            if c:
                cells, at = cells_of(list(c))
                np.add.at(counts[:, k], cells, np.repeat(np.fromiter(c.values(), dtype=np.int64, count=len(c)), np.diff(at)))
            for w, n in c.items():
                scripts.setdefault(script_of(w), np.zeros(len(self.langs)))[k] += n
        self.log = np.log(counts / counts.sum(0)).astype(np.float32)
        totals = np.array([max(1, sum(c.values())) for c in words])
        self.candidates = {s: n / totals >= 0.001 for s, n in scripts.items() if (n / totals >= 0.001).any()}

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): at most 0, 0 for the best; far below for those that the script rules out."""
        cells, at = cells_of(words)
        s = np.add.reduceat(self.log[cells], at[:-1], axis=0)
        s = s / 4  # a letter is in up to four grams
        every = np.ones(len(self.langs), dtype=bool)
        s = np.where(np.array([self.candidates.get(script_of(w), every) for w in words]), s, -1e4)
        return (s - s.max(1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, docs: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """The best labels of each text; docs hold rows of scores. All texts advance together, the longest first."""
    by = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
    lengths = np.array([len(docs[d]) for d in by])
    longest = int(lengths[0]) if len(by) else 0
    # by column: the words at place t of all texts that reach it
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    begin = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate([docs[d] for d in by]) if longest else np.empty(0, int)
    place = np.concatenate([np.arange(n) for n in lengths]) if longest else flat
    row = np.repeat(np.arange(len(by)), lengths)
    columns = np.empty(len(flat), dtype=np.int64)
    columns[begin[place] + row] = flat
    stay, switch = [], []
    now, ends = None, np.empty(0, dtype=np.int64)
    for t in range(longest):
        s = scores[columns[begin[t] : begin[t + 1]]]
        if t:
            now = now[: len(s)]
            best = now.argmax(1)
            jump = now[np.arange(len(s)), best][:, None] - penalty
            stay.append(now >= jump)
            switch.append(best)
            now = np.maximum(now, jump) + s
        else:
            now = s.copy()
        if t + 1 < longest and active[t + 1] == len(s):
            continue
        n = active[t + 1] if t + 1 < longest else 0
        ends = np.concatenate([now[n:].argmax(1), ends])
    out = np.empty(len(flat), dtype=np.int8)
    label = np.empty(0, dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        if len(label) < n:
            label = np.concatenate([label, ends[len(label) : n]])
        out[begin[t] : begin[t + 1]] = label
        if t:
            label = np.where(stay[t - 1][np.arange(n), label], label, switch[t - 1])
    labels = out[begin[place] + row]
    cut = np.split(labels, np.cumsum(lengths)[:-1]) if len(by) else []
    result = [None] * len(docs)
    for d, x in zip(by, cut):
        result[d] = x
    return result


class Labeller:
    """Labels of texts; scores of words are kept between batches, up to _CACHE words."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Of each text: language, its share of the letters, spans (first word, end, language)."""
        docs = [words_of(t) for t in texts]
        if len(self.seen) > _CACHE:
            self.seen, self.table = {}, self.table[:0]
        new = list({w for ws in docs for w in ws if w not in self.seen})
        if new:
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.table = np.concatenate([self.table, *(self.model.scores(new[k : k + 4096]) for k in range(0, len(new), 4096))])
        seen, langs = self.seen, self.model.langs
        ids = [np.fromiter((seen[w] for w in ws), dtype=np.int64, count=len(ws)) for ws in docs]
        out = []
        for ws, labels in zip(docs, viterbi(self.table, ids)):
            if not ws:
                out.append(("und", 0.0, []))
                continue
            letters = np.bincount(labels, np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)), len(langs))
            k = int(letters.argmax())
            edges = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(ws)]]).tolist()
            out.append((langs[k], float(letters[k] / letters.sum()), [(a, b, langs[labels[a]]) for a, b in zip(edges, edges[1:])]))
        return out


def trained(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of at most `sample` texts of each language; None without any."""
    usable = documents.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the share of rows that keeps about 4 samples of each language, so that the window below ranks few rows
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    thin = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, 4 * sample / n)
        thin = thin | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    ranked = usable.where(thin).select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("r")).where(F.col("r") <= sample).select("doc_id", "lang").dropDuplicates(["doc_id"])
    rows = usable.select("doc_id", "text").join(F.broadcast(ranked), "doc_id").dropDuplicates(["doc_id"]).collect() if counts else []  # at most `sample` rows a language
    return Model([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def labelled(docs: DataFrame, model: Model | None, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, spans: first word, end, language) of every row."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches):
        labeller = Labeller(model) if model else None
        for b in slices(batches, 2000):
            got = labeller(b.column(1).to_pylist()) if labeller else [("und", 0.0, [])] * len(b)
            spans = pa.array([[{"first": f, "end": e, "lang": x} for f, e, x in g[2]] for g in got], type=span)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text").mapInArrow(tidy(label), "doc_id long, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = labelled(documents, trained(documents))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))

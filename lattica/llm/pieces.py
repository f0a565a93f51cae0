"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A text becomes one string (blanks as U+2581, one in front); the automaton walks it once, and at each position all pieces
that end there (the match and its output links) relax the best score of that position; of equal scores the longer last
piece stays. Characters that no piece covers cost UNKNOWN below the worst piece and become byte pieces. Decoding gives the
text back, byte for byte: a U+2581 of the text itself is written in byte pieces.

The score of a segmentation is the sum of its pieces' scores, as for a unigram vocabulary. On a vocabulary of merges, whose
scores are merge ranks, that is this method's own segmentation and not the one of repeated merging.

Pieces hold U+2581 only in front (checked when the vocabulary is read; runs of it count as front), so the best
segmentation of a text is that of its words, end to end, and words' results are kept, up to _CACHE words.

Defined cases: null and empty texts have no pieces and decode to an empty text; lone surrogates can't stand in a column;
repeated rows get equal results; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SPACE, UNKNOWN = "▁", 10.0
_CACHE = 120_000
_CUT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """A vocabulary's automaton, and encoding and decoding by it."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int]):
        """pieces: id, text, score; byte_ids: the piece of each byte value."""
        import ahocorasick

        self.auto, self.text = ahocorasick.Automaton(), {}
        for i, p, s in pieces:
            if p and (p not in self.auto or self.auto.get(p)[2] < s):
                self.auto.add_word(p, (len(p), i, s))
            self.text[i] = p
        self.auto.make_automaton()
        self.byte_ids, self.bytes = byte_ids, {i: b for b, i in byte_ids.items()}
        self.unknown = min((s for _, _, s in pieces), default=0.0) - UNKNOWN
        self.by_word = all(SPACE not in p.lstrip(SPACE) for _, p, _ in pieces) and not any(p.startswith(SPACE * 2) and p.strip(SPACE) for _, p, _ in pieces)
        self.seen: dict[str, bytes] = {}
        self.raw = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.bytes.items()}

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        normal = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls(normal, {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)})

    def best(self, s: str) -> list[int]:
        """The ids of the best segmentation of s."""
        n = len(s)
        score, back, piece = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        done, unknown = 0, self.unknown
        for end, (size, i, worth) in self.auto.iter(s):
            end += 1
            while done < end - 1:  # places before this one get no more pieces
                done += 1
                if score[done] is None or score[done - 1] + unknown > score[done]:
                    score[done], back[done], piece[done] = score[done - 1] + unknown, done - 1, -1
            total = score[end - size] + worth
            if score[end] is None or total > score[end]:
                score[end], back[end], piece[end] = total, end - size, i
        while done < n:
            done += 1
            if score[done] is None or score[done - 1] + unknown > score[done]:
                score[done], back[done], piece[done] = score[done - 1] + unknown, done - 1, -1
        out, at = [], n
        while at:
            out += [piece[at]] if piece[at] >= 0 else [self.byte_ids[b] for b in reversed(s[back[at] : at].encode("utf-8", "surrogatepass"))]
            at = back[at]
        return out[::-1]

    def _kept(self, words: list[str]) -> list[bytes]:
        """The ids of words, kept from call to call."""
        seen = self.seen
        got = [seen.get(w) for w in words]
        if None in got:
            if len(seen) >= _CACHE:
                seen.clear()
            for k, g in enumerate(got):
                if g is None:
                    w = words[k]
                    got[k] = seen[w] = seen.get(w) or array("i", self.best(w)).tobytes()
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = text.split(SPACE) if SPACE in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k:
                out.append(array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes())
            s = (SPACE if not k else "") + part.replace(" ", SPACE)
            out += self._kept(_CUT.findall(s)) if self.by_word else [array("i", self.best(s)).tobytes()]
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        raw = map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)
        return b"".join(raw).decode("utf-8", "surrogatepass")[1:]


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row."""

    def encode(batches):
        pieces = Pieces.from_model(model)
        for batch in batches:
            for k in range(0, len(batch), 1000):
                b = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.encode(t) for t in b.column(1).to_pylist()], type=pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text").mapInArrow(tidy(encode), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def decode(batches):
        pieces = Pieces.from_model(model)
        for b in batches:
            values, at = b.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(values[i:j]) for i, j in zip(at, at[1:])], type=pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidy(decode), "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), text_sha256 of the decoded text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")

    def digest(batches):
        import hashlib

        pieces = Pieces.from_model(model)
        for b in batches:
            values, at = b.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
            parts = [values[i:j] for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array([zlib.crc32(p.astype("<i4").tobytes()) for p in parts], type=pa.int64()), pa.array([hashlib.sha256(pieces.decode(p).encode("utf-8", "surrogatepass")).hexdigest() for p in parts])], ["doc_id", "n_pieces", "ids_crc32", "text_sha256"])

    return encoded(docs, model).mapInArrow(tidy(digest), "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string")

"""Token ids as flat binary files with 64-bit document offsets, to be memory-mapped.

Texts are dealt out by ranges of the id, sorted, encoded, and each range becomes one shard of three files: `ids` (unsigned
integers of the least width that holds the vocabulary, end to end), `offsets` (64-bit, one more than documents, counted
within the shard) and `docs` (64-bit document ids). A manifest row a shard holds its counts; prefix sums over the shards
give each one's base, so a document's place in the whole corpus is base + offset. A shard is written under a name of its
own attempt and renamed when it is complete: a repeated or speculative task leaves one whole shard.

Encoding goes word by word through the library, with the results kept: its pre-tokenizer cuts at every single blank or
line end between two words, and at both of two line ends, so the ids of the words, each with the blank or line end before
it, are the text's, end to end. Texts with other white space, or with the opening of a special token, go through the
library whole.

Defined cases: null text counts as empty and gives the end id alone; a null id sorts first; rows that repeat are documents
of their own; an empty table gives no shard and an empty result; extra columns play no part.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tidy

_CACHE = 600_000
#: White space that a text cut into words must not hold, alone or as a run.
_OTHER = ("<|", "  ", " \n", "\n ", "\n\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


class Encoder:
    """Token ids of texts, as bytes of little-endian unsigned integers; the words' are kept, up to _CACHE words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # tokens that begin with a blank, and with a line end
        self.leads = {}
        for lead, mark in ((" ", "\u0120"), ("\n", "\u010a")):
            self.leads[lead] = np.zeros(size, dtype=bool)
            self.leads[lead][[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(mark)]] = True
        self.seen: dict[str, bytes] = {}

    def _together(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words with a blank or line end before each, encoded as one text: no token holds one but in front."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        at = np.flatnonzero(self.leads[lead][ids])
        if len(at) != len(words) or at[0]:
            return self._whole(words)
        data, w = ids.tobytes(), self.dtype.itemsize
        ends = [*(at[1:] * w).tolist(), len(data)]
        return [data[a:b] for a, b in zip((at * w).tolist(), ends)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.seen) > _CACHE:
            self.seen = {}
        seen, cut = self.seen, []
        for t in texts:
            whole = not t or t[0] in " \n" or t[-1] in " \n" or any(map(t.__contains__, _OTHER))
            # each word but those after a line end lacks its blank
            cut.append(None if whole else ("\n" + t).replace("\n", " \n").split(" ")[1:])
        new = list({x for w in cut if w for x in w if x not in seen})
        lines = [x for x in new if x[0] == "\n" and len(x) > 1]
        for lead, some, whole in (("\n", lines, lines), (" ", *(lambda v: (v, [" " + x for x in v]))([x for x in new if x[0] != "\n"]))):
            for k in range(0, len(some), 4096):
                seen.update(zip(some[k : k + 4096], self._together(whole[k : k + 4096], lead)))
        if "\n" in new:
            seen["\n"] = self._whole(["\n"])[0]
        rest = iter(self._whole([t or "" for t, w in zip(texts, cut) if w is None]))
        # the line end put before the text is one id
        return [next(rest) if w is None else b"".join(map(seen.__getitem__, w))[self.dtype.itemsize :] for w in cut]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The Encoder of a worker process, which keeps its words from task to task."""
    return Encoder(path)


def _opened(root: str):
    """A file system and the path in it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _names(root: str, shard: int) -> list[str]:
    return [f"{root}/{shard:06d}.{kind}" for kind in ("ids", "offsets", "docs")]


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, shards: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """Write the files below root, a URI that all executors reach; returns the manifest (shard, n_docs, n_tokens, base, width)."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")

    def store(batches):
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        files, base = _opened(root)
        files.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        final = _names(base, shard)
        attempt = [f"{n}.{uuid.uuid4().hex}" for n in final]
        at, n_docs = 0, 0
        out = [files.open_output_stream(n) for n in attempt]
        out[1].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            for k in range(0, len(batch), 1000):
                b = batch.slice(k, 1000)
                coded = [x + end for x in encoder(b.column(1).to_pylist())]
                ends = at + np.cumsum([len(x) // encoder.dtype.itemsize for x in coded])
                out[0].write(b"".join(coded))
                out[1].write(ends.astype("<i8").tobytes())
                out[2].write(b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy().astype("<i8").tobytes())
                at, n_docs = int(ends[-1]), n_docs + len(b)
        for o in out:
            o.close()
        for a, f in zip(attempt, final):
            files.move(a, f)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [at], "width": [encoder.dtype.itemsize]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    rows = sorted(dealt.mapInArrow(tidy(store), "shard int, n_docs long, n_tokens long, width int").collect())  # one row a shard
    bases = np.cumsum([0, *(r["n_tokens"] for r in rows)])
    table = [(r["shard"], r["n_docs"], r["n_tokens"], int(b), r["width"]) for r, b in zip(rows, bases) if r["n_docs"]]
    return spark.createDataFrame(table, "shard int, n_docs long, n_tokens long, base long, width int")


def read(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as bytes of their width) of each document; local files are memory-mapped."""

    def load(batches):
        files, base = _opened(root)
        for batch in batches:
            for m in batch.to_pylist():
                ids, offsets, docs = _names(base, m["shard"])
                with files.open_input_file(offsets) as o, files.open_input_file(docs) as d:
                    at, names = np.frombuffer(o.read(), "<i8"), np.frombuffer(d.read(), "<i8")
                source = pa.memory_map(ids) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(ids)
                with source:
                    w, k = m["width"], 0
                    while k < len(names):
                        to = max(k + 1, int(np.searchsorted(at, at[k] + 2_000_000, side="right")) - 1)
                        to = min(to, len(names))
                        data = memoryview(source.read_at((int(at[to]) - int(at[k])) * w, int(at[k]) * w))
                        parts = [data[(int(at[i]) - int(at[k])) * w : (int(at[i + 1]) - int(at[k])) * w] for i in range(k, to)]
                        ids_of = pa.array([None if x == np.iinfo(np.int64).min else x for x in names[k:to].tolist()], type=pa.int64())
                        yield pa.RecordBatch.from_arrays([ids_of, pa.array(m["base"] + at[k:to]), pa.array(np.diff(at[k : to + 1])), pa.array([w] * (to - k), type=pa.int32()), pa.array([bytes(p) for p in parts], type=pa.binary())], ["doc_id", "start", "n_tokens", "width", "ids"])
                        k = to

    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(tidy(load), "doc_id long, start long, n_tokens long, width int, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    root = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    manifest = write(docs, root, public_tokenizers.path("byte_bpe_50k.json"))

    def digest(batches):
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(b.column(4).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, type=pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(manifest, root).mapInArrow(tidy(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")

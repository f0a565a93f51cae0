"""Packing: length buckets of least padding by dynamic programming over the global histogram, token-budget batches inside.

A text's length is its number of words. The histogram of all lengths (partial aggregation, one row a distinct length) goes
to the driver: lengths up to FINE are exact, above them those of one of 1024 steps an octave share a row with their exact
longest and sum, so it has at most FINE + 1024 log2(longest / FINE) rows, whatever the number of texts. Bounds are real
lengths and costs exact; only bounds inside such a step are not tried. Dynamic programming then chooses the bucket
bounds that minimise the total padding: cost(i, j) = L_j (C_j - C_i) - (S_j - S_i) for counts C and sums S up to a length,
a lower envelope of lines for each number of buckets, hence exact in time buckets * lengths.

A batch of a bucket of bound L holds budget // L texts, all padded to L (one text if L is above the budget). A text's place
in its bucket is its rank by length and id: texts are dealt out by ranges of (bucket, length, id, partition), counted by
partition and bucket, and a prefix sum over these few counts gives each partition its base. No bucket is gathered in a task.

Defined cases: texts without words (null, empty) form bucket 0 of length 0, in batches of `budget` texts; ties in length
go by id, nulls first, and rows that repeat are texts of their own; an empty table gives an empty result; extra columns
play no part.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Scratch, text_or_empty

FINE, STEPS = 1 << 16, 1024
BUCKETS, BUDGET = 16, 16_384


def length_of(text: str = "text") -> Column:
    """Words of a text: runs that hold no ASCII white space."""
    return F.regexp_count(text_or_empty(F.col(f"`{text}`")), F.lit(f"[^{WHITE}]+")).cast("long")


def rounded(length: Column) -> Column:
    """length up to FINE, above it the next of STEPS steps of its octave."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - int(np.log2(STEPS)))
    return F.when(length <= FINE, length).otherwise((F.ceil(length / step) * step).cast("long"))


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS, sums: list[int] | None = None) -> list[int]:
    """Upper bounds of at most `buckets` buckets over distinct ascending lengths that make the total padding least.

    A length may stand for shorter ones too; `sums` then has the sum of the lengths it stands for."""
    m = len(lengths)
    if m <= buckets:
        return list(lengths)
    c, s = [0], [0]
    for x, n, total in zip(lengths, counts, sums or [x * n for x, n in zip(lengths, counts)]):
        c.append(c[-1] + n)
        s.append(s[-1] + total)
    best = [0] + [None] * m
    back = []
    for k in range(1, buckets + 1):
        # new[j] = L_j C_j - S_j + min over i < j of (best[i] + S_i) - C_i L_j; slopes fall and queries rise
        lines: deque = deque()
        new, came = [None] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                slope, cut, i = -c[j - 1], best[j - 1] + s[j - 1], j - 1
                while len(lines) > 1 and (cut - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                    lines.pop()
                lines.append((slope, cut, i))
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            if lines:
                new[j], came[j] = x * c[j] - s[j] + lines[0][0] * x + lines[0][1], lines[0][2]
        back.append(came)
        best = new
    out, j = [], m
    for k in range(buckets, 0, -1):
        out.append(lengths[j - 1])
        j = back[k - 1][j]
        if not j:
            break
    return out[::-1]


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bounds for a column n_words of positive lengths."""
    table = lengths.where("n_words > 0").groupBy(rounded(F.col("n_words")).alias("cell")).agg(F.max("n_words").alias("n"), F.count("*").alias("c"), F.sum("n_words").alias("s")).toArrow()
    n, c, s = (table[k].to_numpy() for k in ("n", "c", "s"))
    by = np.argsort(n)
    return bounds(n[by].tolist(), c[by].tolist(), buckets, s[by].tolist())


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_column: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, bucket (from 1; 0 without words), bucket_words, batch, place in it, padding."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    lengths = scratch.keep(docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), length_of().alias("n_words")), "lengths")
    edges = [0, *bucket_bounds(lengths, buckets)]
    bucket = sum((F.when(F.col("n_words") > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0))
    bound = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id and length are dealt out by a hash of their partition's place, else they would be one range
    with_bucket = lengths.withColumn("bucket", bucket).withColumn("__tie", F.monotonically_increasing_id())
    dealt = with_bucket.repartitionByRange(parts, "bucket", "n_words", "doc_id", "__tie").sortWithinPartitions("bucket", "n_words", "doc_id", "__tie").drop("__tie")
    # the place in the partition: the low 33 bits of the id that Spark gives rows in order
    numbered = dealt.withColumn("__id", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("__id", 33), "i": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    numbered = scratch.keep(numbered, "numbered")
    scratch.drop("lengths")
    counts = numbered.groupBy("part", "bucket").agg(F.count("*").alias("c"), F.min("i").alias("low"))  # partitions + buckets rows at most
    base = counts.withColumn("base", F.sum("c").over(Window.partitionBy("bucket").orderBy("part")) - F.col("c")).select("part", "bucket", (F.col("base") - F.col("low")).alias("shift"))
    ranked = numbered.join(F.broadcast(base), ["part", "bucket"]).withColumn("rank", F.col("i") + F.col("shift"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1)))).cast("long")
    return ranked.select("doc_id", "n_words", F.col("bucket").cast("long").alias("bucket"), bound.alias("bucket_words"), F.floor(F.col("rank") / size).cast("long").alias("batch"), (F.col("rank") % size).cast("long").alias("place"), (bound - F.col("n_words")).alias("padding"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, seconds: int = 86_400, into: str = "met") -> DataFrame:
    """left with a struct `into`: the last row of right with the same `by` and a time `at` not after the row's; null without one.

    Both tables have timestamps in `at`. Rows meet in buckets of (by, time span), so that a frequent key is spread over
    the buckets of its times; a bucket's own last row is combined before the shuffle and carried to the buckets behind it.
    A null key or time meets nothing.
    """
    bucket = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).alias("__b")
    row = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    theirs = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by), F.col(at).alias("__t"), bucket, row.alias("__r"))
    mine = left.withColumns({"__b": bucket, "__t": F.col(at), "__own": F.struct(*[F.col(f"`{c}`") for c in left.columns])}).select(by, "__t", "__b", "__own")
    last = theirs.groupBy(by, "__b").agg(F.max_by("__r", "__t").alias("__last"))
    spans = mine.select(by, "__b").distinct().join(last, [by, "__b"], "full")
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(by, "__b", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    kind = right.select(row.alias("r")).schema["r"].dataType
    own = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("r")).schema["r"].dataType
    every = theirs.select(by, "__b", "__t", F.lit(0).alias("__side"), "__r", F.lit(None).cast(own).alias("__own")).unionByName(mine.select(by, "__b", "__t", F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__r"), "__own"))
    inside = Window.partitionBy(by, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("__in", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1")
    joined = found.join(carried, [by, "__b"], "left")
    met = F.when(F.col(by).isNotNull() & F.col("__t").isNotNull(), F.coalesce("__in", "__carried"))
    return joined.select("__own.*", met.alias(into))

"""Vector similarity, from native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1; 0 if a norm is."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def top_similar(df, vector: list[float], column: str = "embedding", k: int = 10, threshold: float = 0.0, id_column: str = "vec_id"):
    """The k rows most similar to a vector, at or above a threshold: a map and a top-k, no shuffle of the table."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return df.withColumn("similarity", cosine(F.col(column), q)).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), id_column).limit(k)

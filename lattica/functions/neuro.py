"""Fuzzy matching and learning expressions, all built from native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word of the pattern matches above MATCHED; the score weighs the share of matched words and the mean
# similarity of all of the pattern's words; a score below FLOOR counts as none; a clause without a strength takes DEFAULT_STRENGTH.
MATCHED, RATIO_WEIGHT, MEAN_WEIGHT, FLOOR, DEFAULT_STRENGTH = 0.7, 0.7, 0.3, 0.3, 0.5

#: The score of lower-case texts {v} and {p} in SQL: contained 1, else by the best of the text's words for each of the pattern's.
_SCORE = f"""CASE WHEN contains({{v}}, {{p}}) THEN 1D WHEN trim({{p}}) = '' OR trim({{v}}) = '' THEN 0D ELSE
aggregate(transform(filter(split({{p}}, '\\\\s+'), w -> w <> ''), w -> array_max(transform(filter(split({{v}}, '\\\\s+'), x -> x <> ''), x ->
  CASE WHEN contains(x, w) OR contains(w, x) THEN 1D ELSE 1D - levenshtein(x, w) / greatest(octet_length(x), octet_length(w)) END))),
  named_struct('n', 0, 'm', 0, 's', 0D), (a, b) -> named_struct('n', a.n + 1, 'm', a.m + IF(b > {MATCHED}D, 1, 0), 's', a.s + b),
  a -> IF({RATIO_WEIGHT}D * a.m / a.n + {MEAN_WEIGHT}D * a.s / a.n < {FLOOR}D, 0D, {RATIO_WEIGHT}D * a.m / a.n + {MEAN_WEIGHT}D * a.s / a.n)) END"""


def neuromatch_sql(value: str, pattern: str) -> str:
    """Similarity of two SQL expressions, 0 to 1; null where one is."""
    bound = _SCORE.format(v="z.v", p="z.p")
    return f"transform(array(named_struct('v', lower(CAST({value} AS STRING)), 'p', lower(CAST({pattern} AS STRING)))), z -> IF(z.v IS NULL OR z.p IS NULL, NULL, {bound}))[0]"


def neuromatch(value: Column, pattern: str) -> Column:
    """Similarity of a text with a pattern, 0 to 1: 1 if it contains the pattern, else by words and edit distance."""
    low = F.lower(value)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    parts = pattern.lower().split()
    contained = F.contains(low, F.lit(pattern.lower()))

    def best(p: str) -> Column:
        similar = lambda w: F.when(F.contains(w, F.lit(p)) | F.contains(F.lit(p), w), F.lit(1.0)).otherwise(1 - F.levenshtein(w, F.lit(p)) / F.greatest(F.octet_length(w), F.lit(len(p.encode()))))
        return F.array_max(F.transform(words, similar))

    def combined(each: Column) -> Column:
        """each: the best similarity for every word of the pattern."""
        score = RATIO_WEIGHT * F.size(F.filter(each, lambda x: x > MATCHED)) / len(parts) + MEAN_WEIGHT * F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(parts)
        return F.when(score < FLOOR, F.lit(0.0)).otherwise(score)

    if not parts:
        return F.when(contained, F.lit(1.0)).otherwise(F.when(value.isNotNull(), F.lit(0.0)))
    by_words = F.transform(F.array(F.array(*map(best, parts))), combined)[0]
    return F.when(contained, F.lit(1.0)).otherwise(F.when(F.size(words) == 0, F.lit(0.0)).otherwise(by_words))


def neuromatch_filter(df, pattern: str, field: str | None = None, strength: float = DEFAULT_STRENGTH):
    """Rows whose field, or best of all columns, reaches the strength; the score is a column `match_score`."""
    scores = [F.coalesce(neuromatch(F.col(c).cast("string"), pattern), F.lit(0.0)) for c in ([field] if field else df.columns)]
    return df.withColumn("match_score", F.greatest(*scores) if len(scores) > 1 else scores[0]).where(F.col("match_score") >= strength)


def synaptic_weight(x: Column, kind: str) -> Column:
    """Activity of a value: null 0, truth 0 or 1, a number's sigmoid of a hundredth, a text's hash in thousandths, else its length."""
    if kind == "boolean":
        return F.coalesce(x.cast("double"), F.lit(0.0))
    if kind == "string":
        return F.coalesce(F.pmod(F.xxhash64(x), F.lit(1000)) / 1000, F.lit(0.0))
    if kind == "binary":
        return F.coalesce(F.octet_length(x) % 100 / 100, F.lit(0.0))
    return F.coalesce(1 / (1 + F.exp(-x / 100)), F.lit(0.0))


def richness(x: Column) -> Column:
    """The weight of a text as a condition: half by its length up to 100, half by its share of distinct characters; 0 for an empty one."""
    n = F.length(x)
    kinds = F.size(F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")))
    return F.when(n > 0, 0.5 * F.least(n / 100, F.lit(1.0)) + 0.5 * kinds / n).otherwise(F.lit(0.0))


def hebbian(a: Column, b: Column, rate: float = 1.0) -> Column:
    """Joint activity of two numbers, more if they are equal and less if one is missing, times a rate; 0 to 1."""
    joint = synaptic_weight(a, "double") * synaptic_weight(b, "double")
    factor = F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.2).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), joint * factor)) * min(1.0, max(0.0, rate))


# Activation functions and their derivatives by x.
def activation(x: Column, name: str) -> Column:
    return {"sigmoid": lambda: 1 / (1 + F.exp(-x)), "relu": lambda: F.greatest(x, F.lit(0.0)), "tanh": lambda: F.tanh(x), "linear": lambda: x, "leaky_relu": lambda: F.when(x > 0, x).otherwise(0.01 * x)}[name]()


def derivative(x: Column, name: str) -> Column:
    s = 1 / (1 + F.exp(-x))
    return {"sigmoid": lambda: s * (1 - s), "relu": lambda: F.when(x > 0, 1.0).otherwise(0.0), "tanh": lambda: 1 - F.tanh(x) * F.tanh(x), "linear": lambda: F.lit(1.0), "leaky_relu": lambda: F.when(x > 0, 1.0).otherwise(0.01)}[name]()

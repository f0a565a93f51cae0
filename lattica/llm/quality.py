"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures of a whole text (null: empty), all from built-in expressions, so the scan, the measures and the verdict are one
map-only stage: no shuffle, whatever the input's size or skew.

Defined cases: null or empty text has zero words and ratios of 0, and fails the base rule; repeated rows get equal
verdicts; an empty table gives an empty table; the caller's other columns, of any name, pass through `judge` untouched
because measures live in one struct column whose name the caller picks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, fresh, let, text_or_empty

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not are from this have an or at which but has were "
    "le la les de des du un une et est en que qui dans pour sur avec au par il pas plus ce sont "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "el los las del y en que se por con para una su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= measure <= high; None is open. min_words: rules of ratios need that many words to mean something."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The production table. Ratios are per word unless they are named otherwise.
RULES = (
    Rule("mean_word_chars", 1.5, 24.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("upper_ratio", None, 0.6, 50),
    Rule("stop_ratio", 0.02, None, 50),
    Rule("dup_line_ratio", None, 0.4),
    Rule("table_line_ratio", None, 0.7, 50),
)


def measures(text: Column) -> Column:
    """A struct of counts and ratios of a text column."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        windows = F.when(n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

        def repeated(hashes: Column) -> Column:
            """Words covered by windows whose hash occurs twice: sort (hash, place), keep those beside an equal hash, add up the covered places."""
            pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            twice = let(pairs, lambda s: F.transform(F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])), lambda e: e["i"]))
            covered = let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
            return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)

        return F.struct(
            n.cast("long").alias("n_words"),
            let(windows, repeated).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        )

    chars = F.length(F.regexp_replace(text, f"[{WHITE}]+", ""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(chars == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    by_line = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"), F.size(F.filter(a, lambda x: F.contains(x, F.lit(" | ")))).alias("table")))
    counts = F.struct(
        let(words, of_words).alias("w"),
        chars.cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("upper"),
        by_line.alias("l"),
    )

    def ratios(c: Column) -> Column:
        n = c["w"]["n_words"]
        per = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["dup"].cast("long").alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            per(c["word_chars"], n).alias("mean_word_chars"),
            per(c["n_symbols"], c["word_chars"]).alias("symbol_ratio"),
            per(c["upper"], c["word_chars"]).alias("upper_ratio"),
            per(c["w"]["n_stop"], n).alias("stop_ratio"),
            per(c["l"]["dup"], c["l"]["n"]).alias("dup_line_ratio"),
            per(c["l"]["table"], c["l"]["n"]).alias("table_line_ratio"),
        )

    return let(counts, ratios)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def compiled(rules, m: Column) -> Column:
    """True where every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        ok = ok if r.low is None else ok & (m[r.measure] >= r.low)
        ok = ok if r.high is None else ok & (m[r.measure] <= r.high)
        verdict = verdict & ((m["n_words"] < r.min_words) | ok if r.min_words else ok)
    return verdict


def judge(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES) -> DataFrame:
    """docs with a struct column `into`: the measures, base_failed and kept."""
    measured = let(measures(text_or_empty(F.col(f"`{text}`"))), lambda m: F.struct(m.alias("m"), base_failed(m).alias("base_failed"), (~base_failed(m) & compiled(rules, m)).alias("kept")))
    return docs.withColumn(into, measured)


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    own = fresh(docs.columns, "quality")[0]
    return judge(docs, text, own, rules).where(F.col(f"{own}.kept")).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = judge(docs).select("doc_id", "quality.*")
    return q.select("doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", *[F.round(f"m.{c}", 6).alias(c) for c in ("stop_ratio", "upper_ratio", "table_line_ratio")])


def verdict_sql(table: str = "documents", extra: str = "") -> str:
    """DuckDB SQL of the same measures and verdict, one row per row of table."""
    ws = r"[\x20\x09-\x0D]+"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = []
    for r in RULES:
        ok = " AND ".join(x for x in (f"{r.measure} >= {r.low}" if r.low is not None else "", f"{r.measure} <= {r.high}" if r.high is not None else "") if x)
        rules.append(f"(n_words < {r.min_words} OR ({ok}))" if r.min_words else f"({ok})")
    return f"""
WITH q0 AS (SELECT *, coalesce(text, '') AS t FROM {table}),
q1 AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
  length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS upper FROM q0),
q2 AS (SELECT *, len(ws) AS n_words, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS win FROM q1),
q3 AS (SELECT *, map_from_entries(list_filter(map_entries(list_histogram(win)), lambda e: e.value > 1)) AS rep FROM q2),
q4 AS (SELECT *, list_transform(win, lambda x: map_contains(rep, x)) AS hit FROM q3),
q5 AS (SELECT *, CASE WHEN cardinality(rep) = 0 THEN 0 ELSE len(list_filter(range(1, len(ws) + 1), lambda i: coalesce(hit[i], false) OR (i > 1 AND coalesce(hit[i - 1], false)) OR (i > 2 AND coalesce(hit[i - 2], false)))) END AS n_repeat_words,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_filter(ls, lambda x: contains(x, ' | '))) AS n_table,
  len(list_filter(ws, lambda w: lower(w) IN ({stop}))) AS n_stop FROM q4),
q6 AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
  CASE WHEN word_chars > 0 THEN upper / word_chars ELSE 0 END AS upper_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
  CASE WHEN len(ls) > 0 THEN n_dup_lines / len(ls) ELSE 0 END AS dup_line_ratio,
  CASE WHEN len(ls) > 0 THEN n_table / len(ls) ELSE 0 END AS table_line_ratio,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM q5),
q7 AS (SELECT *, NOT base_failed AND {' AND '.join(rules)} AS kept FROM q6)
SELECT doc_id{extra}, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept,
  round(stop_ratio, 6) AS stop_ratio, round(upper_ratio, 6) AS upper_ratio, round(table_line_ratio, 6) AS table_line_ratio FROM q7"""


SQL = verdict_sql()

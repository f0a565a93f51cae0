"""Information-theoretic sanitisation of personal data, from built-in functions only.

Base spans come from four patterns (email, ip, card, phone). The method adds terms: a word discloses a kind of protected
entity as far as its pointwise mutual information with that kind, over the whole corpus, explains the kind's own
information. With p(k) the share of word places that lie beside an entity of kind k and p(k | t) that share among the
places of term t, the disclosure is PMI(t; k) / -log2 p(k) = 1 - log2 p(k | t) / log2 p(k): 0 for a term that says
nothing, 1 for one that never stands elsewhere. Terms at `remove_at` or more are removed, those at `generalise_at` or
more give way to the kind's name; base spans are always replaced. Support counts the distinct
entities (their hashes) within reach of a term's places, so copies of one text add nothing to it.

Plan: one pass counts words and contexts (partial aggregation before a shuffle on the word, so a frequent word is one row
a task); a second marks the places of disclosing terms. Only texts that hold such a term, found by a join on their
distinct words, are cut into places.

A text's matches, spans and pieces are placed by prefix sums and prefix maxima, so the work grows as n log n with a text
of n matches, whatever its length.

Defined cases: null or empty text has no span and stays as it is; rows that repeat are counted as often as they stand and
get equal results; an empty corpus discloses nothing; extra columns pass through untouched.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, cut, fresh, let, running, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive forms match what the plain ones match, in linear time and without recursion:
# a run that does not lead to a match can't lead to one from its middle, so starts are run starts or ends of matches.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Words of the corpus: runs of letters and digits.
TERM = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Thresholds:
    """reach: words on either side of an entity that count as beside it; support: distinct entities a term must stand beside;
    inline_terms: terms that may stand in the plan; broadcast_rows: rows that may be broadcast. More go through joins."""

    reach: int = 3
    support: int = 8
    generalise_at: float = 0.75
    remove_at: float = 0.9
    inline_terms: int = 1000
    broadcast_rows: int = 50_000


def _luhn(digits: Column) -> Column:
    worth = lambda c, i: F.when(i % 2 == 0, c).when(c < 5, 2 * c).otherwise(2 * c - 9)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: worth(c.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}\z"))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.regexp_like(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
}

_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _located(text: Column, pattern: str) -> Column:
    """Matches with their code point places: a prefix sum over the lengths of the gaps between them and of their own."""

    def places(gaps: Column, hits: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        ends = running(steps, lambda x, y: x + y)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text")))

    p = F.lit(pattern)
    return let(F.split(text, p), lambda g: let(F.regexp_extract_all(text, p, 0), lambda h: places(g, h)))


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind, in order."""
    found = F.filter(_located(text, PATTERNS[kind]), lambda s: _holds(kind, s["text"]))
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(_MAY[kind](text), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _covered(spans: Column) -> Column:
    """Spans sorted and merged where they overlap; the first one's kind stays."""

    def groups(sorted_spans: Column, reached: Column) -> Column:
        """reached: the furthest end so far. A span that begins at or behind it begins a group, which ends where the next one begins."""
        item = lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["kind"].alias("kind"))
        heads = F.filter(F.transform(sorted_spans, item), lambda s: (s["i"] == 0) | (F.get(reached, s["i"] - 1) <= s["start"]))
        last = lambda h, j: F.coalesce(F.get(h, j + 1)["i"], F.size(reached)) - 1
        return let(heads, lambda h: F.transform(h, lambda s, j: F.struct(s["start"].alias("start"), F.get(reached, last(h, j)).alias("end"), s["kind"].alias("kind"))))

    ends = lambda a: running(F.transform(a, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) < 2, spans).otherwise(let(F.array_sort(spans), lambda a: let(ends(a), lambda m: groups(a, m)))).cast(_SPANS)


def _replaced(text: Column, spans: Column, name) -> Column:
    """text with each of the sorted, disjoint spans replaced by name(kind, its text)."""

    def pieces(parts: Column, own: Column) -> Column:
        before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        each = F.transform(own, lambda s, i: F.concat(cut(parts, before(i), s["start"]), name(s["kind"], cut(parts, s["start"], s["end"]))))
        return F.concat(F.array_join(each, ""), cut(parts, F.get(own, F.size(own) - 1)["end"], F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(blocks(text), lambda p: let(spans, lambda own: pieces(p, own))))


def _outside(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of `taken`: both are walked in the order of their places."""

    def told(events: Column) -> Column:
        # a span comes at its end, before what begins there; the furthest end of all taken before must not reach into it
        reach = running(F.transform(events, lambda e: F.when(e["taken"], e["far"]).otherwise(F.lit(-1))), F.greatest)
        return let(reach, lambda m: F.filter(F.transform(events, lambda e, i: F.struct(e["at"].alias("end"), e["far"].alias("start"), (~e["taken"] & (F.get(m, i) <= e["far"])).alias("free"), e["kind"].alias("kind"))), lambda x: x["free"]))

    event = lambda at, far, is_taken, kind: F.struct(at.alias("at"), F.lit(is_taken).alias("taken"), far.alias("far"), kind.alias("kind"))
    every = F.concat(F.transform(spans, lambda s: event(s["end"], s["start"], False, s["kind"])), F.transform(taken, lambda s: event(s["start"], s["end"], True, s["kind"])))
    free = lambda e: F.transform(told(e), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(let(F.array_sort(every), free)).cast(_SPANS)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base(text: Column) -> Column:
    """The base spans of all kinds in the order of KINDS."""
    return F.flatten(F.array(*[base_spans(text, k) for k in KINDS]))


def disclosing_terms(texts: DataFrame, at: Thresholds, scratch: Scratch) -> DataFrame:
    """(term, kind, disclosure) of terms at or above `generalise_at`, from all rows (text, base) of texts."""
    mark = F.lit("\u0000")
    # a mark of its kind and hash stands for each entity, so that words and entities keep their order
    number = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("string")
    marked = lambda kind, entity: F.concat(mark, number(kind), F.xxhash64(entity).cast("string"), mark)
    flat = lambda t, b: _replaced(t, _covered(b), marked)
    word = lambda x, near: F.struct(x.alias("term"), near.alias("near"))
    nothing = F.lit(None).cast("array<string>")

    def beside(tokens: Column) -> Column:
        """Each word with the marks of the entities within reach."""
        around = lambda i: F.slice(tokens, F.greatest(i + 1 - at.reach, F.lit(1)), F.lit(2 * at.reach + 1) - F.greatest(at.reach - i, F.lit(0)))
        marks = lambda i: let(F.filter(around(i), lambda x: F.contains(x, mark)), lambda a: F.when(F.size(a) > 0, F.array_distinct(a)))
        return F.filter(F.transform(tokens, lambda x, i: word(x, marks(i))), lambda w: ~F.contains(w["term"], mark))

    low, has = F.lower("text"), F.size("base") > 0
    near = let(F.regexp_extract_all(flat(low, F.col("base")), F.lit(rf"(\x00[1-4]-?[0-9]+\x00|{TERM})")), beside)
    plain = F.transform(F.regexp_extract_all(low, F.lit(f"({TERM})")), lambda x: word(x, nothing))
    places = texts.select(F.explode(F.when(has, near).otherwise(plain)).alias("w")).select("w.*")
    kinds = F.transform("near", lambda x: F.substring(x, 2, 1).cast("int"))
    # one row for each entity beside a word; the first one, or that of a word beside none, counts the word's place
    words = places.select("term", kinds.alias("kinds"), F.posexplode_outer(F.transform("near", lambda x: F.substr(x, F.lit(3), F.length(x) - 3).cast("long"))).alias("at", "entity"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    flags = [F.sum(F.when(first & F.array_contains("kinds", i + 1), 1).otherwise(0)).alias(f"n{i}") for i in range(len(KINDS))]
    total = words.groupBy("term").agg(F.sum(F.when(first, 1).otherwise(0)).alias("n"), *flags, F.count_distinct("entity").alias("support"))
    # terms of too little support become one row, so that one small table holds the terms in question and the sums of all
    sums = [F.sum(c).alias(c) for c in ("n", *(f"n{i}" for i in range(len(KINDS))))]
    few = scratch.keep(total.groupBy(F.when(F.col("support") >= at.support, F.col("term")).alias("term")).agg(*sums), "counts")
    all_words = few.agg(F.sum("n").alias("all"), *[F.sum(f"n{i}").alias(f"all{i}") for i in range(len(KINDS))])
    held = few.where("term is not null").crossJoin(F.broadcast(all_words))  # one row
    share = [F.struct(F.lit(k).alias("kind"), F.when((F.col(f"n{i}") > 0) & (F.col(f"all{i}") < F.col("all")), 1 - F.log2(F.col(f"n{i}") / F.col("n")) / F.log2(F.col(f"all{i}") / F.col("all"))).alias("disclosure")) for i, k in enumerate(KINDS)]
    best = held.select("term", F.explode(F.array(*share)).alias("s")).select("term", "s.kind", "s.disclosure").where(F.col("disclosure") >= at.generalise_at)
    return best.groupBy("term").agg(F.max_by("kind", "disclosure").alias("kind"), F.max("disclosure").alias("disclosure"))


def sanitise(docs: DataFrame, text: str = "text", into: str = "pii", at: Thresholds = Thresholds()) -> DataFrame:
    """docs with a struct column `into`: base and terms (spans: start, end, kind), and the sanitised text."""
    whole, base, hits, found, k1, k2 = fresh([*docs.columns, into], "whole", "base", "hits", "found", "k1", "k2")
    t = text_or_empty(F.col(f"`{text}`"))
    scratch = Scratch(docs.sparkSession, "pii")
    terms = scratch.keep(disclosing_terms(docs.select(t.alias("text"), _base(t).alias("base")), at, scratch), "terms")
    scratch.drop("counts")
    kind = "array<struct<term:string,kind:string,disclosure:double>>"
    some = terms.orderBy("term").limit(at.inline_terms + 1).collect()
    based = docs.withColumn(whole, t).withColumn(base, _base(F.col(whole)))
    lower_words = F.regexp_extract_all(F.lower(whole), F.lit(f"({TERM})"))
    if len(some) <= at.inline_terms:
        # few terms are part of the plan, and no text is moved
        every = F.from_json(F.lit(json.dumps([r.asDict() for r in some])), kind)
        held = let(F.array_intersect(lower_words, F.transform(every, lambda t: t["term"])), lambda own: F.when(F.size(own) > 0, F.filter(every, lambda t: F.array_contains(own, t["term"]))))
        based = based.withColumn(hits, held if some else F.lit(None).cast(kind))
    else:
        key = {k1: F.xxhash64(whole), k2: F.length(whole)}
        words = based.select(*[c.alias(n) for n, c in key.items()], F.explode(F.array_distinct(lower_words)).alias("term"))
        small = lambda df: F.broadcast(df) if df.limit(at.broadcast_rows + 1).count() <= at.broadcast_rows else df
        each = scratch.keep(words.join(small(terms), "term").groupBy(k1, k2).agg(F.collect_set(F.struct("term", "kind", "disclosure")).alias(hits)), "hits")
        based = based.withColumns(key).join(small(each), [k1, k2], "left").drop(k1, k2)

    def own(own_hits: Column) -> Column:
        by = F.map_from_entries(F.transform(own_hits, lambda h: F.struct(h["term"], F.struct(h["kind"], h["disclosure"]))))
        spans = let(by, lambda m: F.transform(_located(F.col(whole), TERM), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(m, F.lower(s["text"])).alias("h"))))
        named = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.when(s["h"]["disclosure"] >= at.remove_at, "drop-").otherwise("term-"), s["h"]["kind"]).alias("kind"))
        return _outside(F.transform(F.filter(spans, lambda s: s["h"].isNotNull()), named).cast(_SPANS), F.col(base))

    with_terms = based.withColumn(found, F.when(F.col(hits).isNotNull(), own(F.col(hits))).otherwise(F.array().cast(_SPANS)))
    name = lambda k, _: F.when(k.startswith("drop-"), "").when(k.startswith("term-"), F.concat(F.lit("["), F.upper(F.substring(k, 6, 20)), F.lit(" TERM]"))).otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))
    clean = F.when((F.size(base) == 0) & (F.size(found) == 0), F.col(f"`{text}`")).otherwise(_replaced(F.col(whole), _covered(F.concat(base, found)), name))
    return with_terms.withColumn(into, F.struct(F.col(base).alias("base"), F.col(found).alias("terms"), clean.alias("text"))).drop(whole, base, found, hits)


def sanitised(docs: DataFrame, text: str = "text", at: Thresholds = Thresholds()) -> DataFrame:
    """docs with the text column sanitised; every row stays."""
    own = fresh(docs.columns, "pii")[0]
    return sanitise(docs, text, own, at).withColumn(text, F.col(f"{own}.text")).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = sanitise(docs)
    count = lambda k: F.size(F.filter("pii.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.transform(F.array_sort(F.transform(F.concat("pii.base", "pii.terms"), lambda s: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0).cast("long")), F.lit(9).cast("long")).alias("o"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))), lambda s: s)
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("pii.base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.length("pii.text").cast("long").alias("clean_chars"))

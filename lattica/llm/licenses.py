"""License scans: ordered signature rules behind keyword gates, overlaps resolved by priority and interval containment.

A text becomes lower-case words (A-Z only are folded) joined by single blanks. A rule runs as a regular expression over
the words if they hold one of its literals, which are derived from its pattern: every match holds one, so no match is
lost. Each match is an interval of words. A detection whose interval lies within that of a rule of higher priority is suppressed (of equal
intervals and priorities, the rule that stands first stays). All of it is one projection of built-in functions: no
shuffle, and nothing that depends on other rows.

Defined cases: null or empty text gives zero words, no detection, labels '' and score 0; repeated rows get equal results;
an empty table gives an empty table; extra columns pass through untouched beside the struct column the caller names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counts_before, let, running, text_or_empty

#: What a word consists of: digits, letters of either case, and everything past ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The phrases of the base scan and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: family, names as word patterns, versions as (words, label suffix). The rules are the product with TEMPLATES.
FAMILIES = (
    ("mit", "(?:mit|mit x11|x11 mit)", ()),
    ("expat", "expat", ()),
    ("x11", "x11", ()),
    ("apache", "(?:the )?apache(?: software)?", (("1 0", "1.0"), ("1 1", "1.1"), ("2(?: 0)?", "2"))),
    ("gpl", "(?:gnu )?gpl", (("1(?: 0)?", "1"), ("2(?: 0)?", "2"), ("3(?: 0)?", "3"))),
    ("gpl", "gnu general public", (("1(?: 0)?", "1"), ("2(?: 0)?", "2"), ("3(?: 0)?", "3"))),
    ("lgpl", "(?:gnu )?lgpl", (("2(?: 0)?", "2"), ("2 1", "2.1"), ("3(?: 0)?", "3"))),
    ("lgpl", "(?:gnu )?lesser general public", (("2(?: 0)?", "2"), ("2 1", "2.1"), ("3(?: 0)?", "3"))),
    ("lgpl", "gnu library general public", (("2(?: 0)?", "2"),)),
    ("agpl", "(?:gnu )?agpl", (("1(?: 0)?", "1"), ("3(?: 0)?", "3"))),
    ("agpl", "(?:gnu )?affero general public", (("1(?: 0)?", "1"), ("3(?: 0)?", "3"))),
    ("gfdl", "gnu free documentation", (("1 1", "1.1"), ("1 2", "1.2"), ("1 3", "1.3"))),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", ()),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", ()),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", ()),
    ("0bsd", "0bsd", ()),
    ("bsd", "bsd", ()),
    ("mpl", "mozilla public", (("1 0", "1.0"), ("1 1", "1.1"), ("2(?: 0)?", "2"))),
    ("mpl", "mpl", (("1 0", "1.0"), ("1 1", "1.1"), ("2(?: 0)?", "2"))),
    ("epl", "eclipse public", (("1(?: 0)?", "1"), ("2(?: 0)?", "2"))),
    ("epl", "epl", (("1(?: 0)?", "1"), ("2(?: 0)?", "2"))),
    ("cddl", "cddl", (("1 0", "1.0"), ("1 1", "1.1"))),
    ("cddl", "common development and distribution", (("1 0", "1.0"), ("1 1", "1.1"))),
    ("cpl", "common public", (("1 0", "1.0"),)),
    ("eupl", "eupl", (("1 0", "1.0"), ("1 1", "1.1"), ("1 2", "1.2"))),
    ("eupl", "european union public", (("1 0", "1.0"), ("1 1", "1.1"), ("1 2", "1.2"))),
    ("isc", "isc", ()),
    ("zlib", "zlib(?: libpng)?", ()),
    ("bsl", "boost(?: software)?", (("1(?: 0)?", "1"),)),
    ("busl", "business source", (("1 1", "1.1"),)),
    ("sspl", "server side public", (("1(?: 0)?", "1"),)),
    ("unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", (("2(?: 0)?", "2"),)),
    ("artistic", "artistic", (("1(?: 0)?", "1"), ("2(?: 0)?", "2"))),
    ("ofl", "(?:sil )?open font", (("1 0", "1.0"), ("1 1", "1.1"))),
    ("postgresql", "postgresql", ()),
    ("python", "python(?: software foundation)?", (("2(?: 0)?", "2"),)),
    ("php", "php", (("3 0", "3.0"), ("3 01", "3.01"))),
    ("ruby", "ruby", ()),
    ("openssl", "openssl", ()),
    ("ms-pl", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", ()),
    ("odbl", "open (?:data commons open )?database", (("1 0", "1.0"),)),
    ("upl", "universal permissive", (("1 0", "1.0"),)),
    ("afl", "academic free", (("2 1", "2.1"), ("3 0", "3.0"))),
    ("osl", "(?:open software|osl)", (("2 1", "2.1"), ("3 0", "3.0"))),
    ("cc0", "cc0", (("1 0", "1.0"),)),
) + tuple((f"cc-{'-'.join(parts)}", (f"cc {' '.join(parts)}" if short else "creative commons " + " ".join({"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s"}[p] for p in parts)), tuple((f"{v} 0", f"{v}.0") for v in (1, 2, 3, 4)))
          for short in (True, False) for parts in (("by", "nc", "sa"), ("by", "nc", "nd"), ("by", "nc"), ("by", "sa"), ("by", "nd"), ("by",)))

_GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|redistributed|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
#: name, priority (1 is highest), confidence, pattern of a versioned and of an unversioned rule.
TEMPLATES = (
    ("tag", 1, 1.0, "spdx licen[sc]e identifier {n} (?:licen[sc]e )?(?:v|version )?{v}", "spdx licen[sc]e identifier {n}"),
    ("grant", 2, 0.95, _GRANT + "{n} (?:licen[sc]e )?(?:v|version )?{v}", _GRANT + "{n}(?: licen[sc]e)?"),
    ("title", 3, 0.8, "{n} licen[sc]e (?:v|version )?{v}", "{n} licen[sc]e"),
)
#: Rules that stand outside the families: name, label, priority, confidence, pattern. Sentences of license texts and notices.
_GNU_NOTICE = "under the terms of (?:version {v} of )?the gnu {n} public license(?: version {v})? as published by the free software foundation(?: either version {v}(?: of the license)?(?: or (?:at your option )?any later version)?)?"
OTHERS = (
    ("all rights reserved", "proprietary", 4, 0.6, "all rights reserved"),
    ("proprietary", "proprietary", 3, 0.8, "(?:proprietary and confidential|proprietary licen[sc]e)"),
    ("unauthorized copying", "proprietary", 2, 0.9, "unauthori[sz]ed copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("no redistribution", "proprietary", 3, 0.7, "(?:may not|must not) be (?:copied|reproduced|distributed|redistributed) without (?:the )?(?:express |prior |explicit )?(?:written )?(?:permission|consent)"),
    ("public domain", "public-domain", 4, 0.6, "(?:in|into|to) the public domain"),
    ("copyleft", "copyleft", 4, 0.5, "copyleft"),
    ("mit grant", "mit", 2, 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit condition", "mit", 3, 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc grant", "isc", 2, 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd disclaimer", "isc", 4, 0.5, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd grant", "bsd", 2, 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd third clause", "bsd-3-clause", 2, 0.95, "neither the name of (?:the )?(?:copyright holder|author|organi[sz]ation|university) nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd fourth clause", "bsd-4-clause", 2, 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache notice", "apache-2", 2, 0.95, "you may not use this file except in compliance with the license(?: you may obtain a copy of the license at https? www apache org licenses license 2 0)?"),
    ("apache address", "apache-2", 2, 0.95, "www apache org licenses license 2 0"),
    ("gpl address", "gpl", 3, 0.7, "www gnu org licenses gpl"),
    ("gpl notice 2", "gpl-2", 4, 0.95, _GNU_NOTICE.format(n="general", v="2")),
    ("gpl notice 3", "gpl-3", 4, 0.95, _GNU_NOTICE.format(n="general", v="3")),
    ("lgpl notice 2.1", "lgpl-2.1", 4, 0.95, _GNU_NOTICE.format(n="lesser general", v="2 1")),
    ("lgpl notice 3", "lgpl-3", 4, 0.95, _GNU_NOTICE.format(n="lesser general", v="3")),
    ("agpl notice 3", "agpl-3", 4, 0.95, _GNU_NOTICE.format(n="affero general", v="3")),
    ("gfdl notice", "gfdl", 2, 0.9, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl notice 2", "mpl-2", 2, 0.95, "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl notice 1.1", "mpl-1.1", 2, 0.9, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl notice", "epl-2", 2, 0.9, "made available under the terms of the eclipse public license v(?:ersion)? 2 0"),
    ("cddl notice", "cddl", 2, 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib grant", "zlib", 2, 0.95, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost grant", "bsl-1", 2, 0.95, "boost software license version 1 0"),
    ("unlicense text", "unlicense", 2, 0.95, "this is free and unencumbered software released into the public domain"),
    ("wtfpl text", "wtfpl-2", 2, 0.95, "do what the fuck you want to public license"),
    ("ofl notice", "ofl-1.1", 2, 0.95, "this font software is licensed under the sil open font license version 1 1"),
    ("cc0 dedication", "cc0-1.0", 2, 0.9, "to the extent possible under law(?: the author| the person who associated cc0 with this work)? has(?: dedicated| waived) all copyright and related or neighboring rights"),
    ("cc address", "creative-commons", 3, 0.7, "creativecommons org licenses"),
    ("cc0 address", "cc0-1.0", 2, 0.9, "creativecommons org publicdomain zero 1 0"),
    ("cc international", "creative-commons", 4, 0.7, "licensed under a creative commons"),
    ("artistic preamble", "artistic", 3, 0.8, "the copyright holder maintains some semblance of artistic control"),
    ("eula", "proprietary", 3, 0.7, "end user licen[sc]e agreement"),
    ("trial", "proprietary", 4, 0.5, "for (?:evaluation|trial|internal use) (?:purposes )?only"),
)


def rules() -> list[dict]:
    """The ordered rules: place, name, label, priority, confidence, pattern."""
    out = []
    for kind, priority, score, versioned, plain in TEMPLATES:
        for family, names, versions in FAMILIES:
            for words, suffix in versions:
                out += [(f"{kind} {names} {suffix}", f"{family}-{suffix}", 2 * priority, score, versioned.format(n=names, v=f"{words}(?: or (?:any )?later(?: version)?)?"))]
            out += [(f"{kind} {names}", family, 2 * priority + 1, score - 0.1, plain.format(n=names))]
    out += [(name, label, 2 * priority, score, pattern) for name, label, priority, score, pattern in OTHERS]
    return [{"place": i, "name": n, "label": lab, "priority": p, "score": round(s, 2), "pattern": f" {x}(?= )"} for i, (n, lab, p, s, x) in enumerate(out)]


def expanded(pattern: str) -> list[str]:
    """All strings that a pattern of characters, (?:a|b), [ab] and ? matches."""

    def read(i: int) -> tuple[list[str], int]:
        done, now = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                done, now, i = done + now, [""], i + 1
                continue
            if pattern.startswith("(?:", i):
                some, i = read(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                some, i = list(pattern[i + 1 : end]), end + 1
            else:
                some, i = [pattern[i]], i + 1
            if pattern[i : i + 1] == "?":
                some, i = [*some, ""], i + 1
            now = [a + b for a in now for b in some]
        return done + now, i

    return read(0)[0]


def literals(*patterns: str) -> list[str]:
    """Runs of whole words, blanks around them, of which every match of the patterns holds one; none lies in another."""
    every = {f" {x.strip()} " for p in patterns for x in expanded(p)}
    return sorted(x for x in every if not any(y != x and y in x for y in every))


def keywords(*patterns: str) -> list[str]:
    """The longest word of each string that the patterns match, blanks around it."""
    return sorted({f" {max(x.split(), key=lambda w: (len(w), w))} " for p in patterns for x in expanded(p)})


def gated_rules() -> list[tuple[list[str], list[dict]]]:
    """rules() in groups: literals of which each match in the group holds one, and the rules, each with literals of its own."""
    by_names = {kind: [(names, len(versions) + 1) for _, names, versions in FAMILIES] for kind, *_ in TEMPLATES}
    heads = {"tag": literals("spdx licen[sc]e identifier"), "grant": literals(_GRANT), "title": literals("licen[sc]e")}
    left, out = iter(rules()), []
    for kind, *_ in TEMPLATES:
        out.append((heads[kind], [next(left) | {"literals": literals(names)} for names, n in by_names[kind] for _ in range(n)]))
    others = [r | {"literals": keywords(x)} for r, (*_, x) in zip(left, OTHERS, strict=True)]
    return [*out, (keywords(*[x for *_, x in OTHERS]), others)]


_SCHEMA = "array<struct<place:int,name:string,label:string,priority:int,score:double,pattern:string,literals:array<string>>>"


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(joined: Column, pattern: Column) -> Column:
    """Word intervals (start, end exclusive) of a pattern's matches; joined has a blank before each word and at its end."""

    def found(gaps: Column, hits: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: _blanks(g) + _blanks(h)), lambda x, y: x + y)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - _blanks(h)).alias("start"), e.alias("end")))

    return let(F.split(joined, pattern), lambda g: let(F.regexp_extract_all(joined, pattern, 0), lambda h: found(g, h)))


def _unbeaten(sorted_hits: Column, beats) -> Column:
    """The detections, sorted by place, that none beats: what holds an interval begins no further before its start than the longest match has words."""
    longest = max(len(x.split()) for r in rules() for x in expanded(r["pattern"].removesuffix("(?= )")))

    def told(starts: Column) -> Column:
        first, end = counts_before(starts, F.transform(starts, lambda s: s - longest)), counts_before(starts, F.transform(starts, lambda s: s + 1))
        near = lambda ranges: F.transform(sorted_hits, lambda d, i: F.struct(F.exists(F.slice(sorted_hits, F.get(ranges, i)["a"] + 1, F.get(ranges, i)["b"] - F.get(ranges, i)["a"]), lambda e: beats(e, d)).alias("beaten"), d.alias("d")))
        return let(F.zip_with(first, end, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: F.transform(F.filter(near(r), lambda x: ~x["beaten"]), lambda x: x["d"]))

    return let(F.transform(sorted_hits, lambda d: d["start"]), told)


def scanned(text: Column) -> Column:
    """A struct of a text: n_words, base (place intervals with labels), detections that survive, labels, score."""
    groups = [(heads, F.from_json(F.lit(json.dumps(own)), _SCHEMA)) for heads, own in gated_rules()]
    joined = F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), GAP, " ")
    none = "array<struct<start:int,end:int,label:string,place:int,priority:int,score:double,name:string>>"

    def result(j: Column) -> Column:
        item = lambda iv, r: F.struct(iv["start"].alias("start"), iv["end"].alias("end"), r["label"].alias("label"), r["place"].alias("place"), r["priority"].alias("priority"), r["score"].alias("score"), r["name"].alias("name"))
        of = lambda table: F.flatten(F.transform(F.filter(table, lambda r: F.exists(r["literals"], lambda x: F.contains(j, x))), lambda r: F.transform(_places(j, r["pattern"]), lambda iv: item(iv, r)))).cast(none)
        # halves keep the expression's depth low
        held = lambda heads: F.contains(j, F.lit(heads[0])) if len(heads) == 1 else held(heads[: len(heads) // 2]) | held(heads[len(heads) // 2 :])
        hits = F.concat(*[F.when(held(heads), of(table)).otherwise(F.array().cast(none)) for heads, table in groups])
        beats = lambda e, d: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (((e["end"] - e["start"]) > (d["end"] - d["start"])) | (e["place"] < d["place"]))))
        kept = let(F.array_sort(hits), lambda a: F.when(F.size(a) < 64, F.filter(a, lambda d: ~F.exists(a, lambda e: beats(e, d)))).otherwise(_unbeaten(a, beats)))
        labelled = lambda lab: lambda iv: F.struct(iv["start"].alias("start"), iv["end"].alias("end"), F.lit(lab).alias("label"))
        base = F.flatten(F.array(*[F.when(F.contains(j, F.lit(f" {p} ")), F.transform(_places(j, F.lit(f" {p}(?= )")), labelled(lab))).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")) for p, lab in BASE]))
        return F.struct(base.alias("base"), kept.alias("detections"))

    def summed(j: Column, d: Column) -> Column:
        labels = lambda a: F.transform(a, lambda x: x["label"])
        base, own = labels(d["base"]), labels(d["detections"])
        joined_labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
        starts = F.transform(d["base"], lambda x: x["start"])
        return F.struct(
            (_blanks(j) - 1).cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            joined_labels(base).alias("base_labels"),
            joined_labels(F.concat(base, own)).alias("labels"),
            F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(d["detections"], lambda x: x["score"])), F.lit(0.0))).alias("score"),
            d["detections"].alias("detections"),
        )

    return let(joined, lambda j: let(result(j), lambda d: summed(j, d)))


def scan(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """docs with a struct column `into`: counts, labels, score and the surviving detections (word intervals and rule names)."""
    return docs.withColumn(into, scanned(text_or_empty(F.col(f"`{text}`"))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", *[F.col(f"licenses.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def sql(table: str = "documents") -> str:
    """DuckDB SQL of the scan: every rule runs on every text, without any gate."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    # RE2 has no look-ahead: with three blanks between words, a match takes two before it and one behind, and its neighbour the rest
    spread = lambda p: "  " + p.removesuffix("(?= )")[1:].replace(" ?", "(?: )?").replace(" ", "   ")
    values = ",\n".join(f"({r['place']}, {quoted(r['label'])}, {r['priority']}, {r['score']}, {quoted(spread(r['pattern']))})" for r in rules())
    base = ",\n".join(f"({quoted(p)}, {quoted(lab)}, {len(p.split())})" for p, lab in BASE)
    return f"""
WITH r(place, label, priority, score, pattern) AS (VALUES {values}),
b(phrase, label, n) AS (VALUES {base}),
d1 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM {table}),
d2 AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, '   ' || array_to_string(w, '   ') || '   ' AS jj FROM d1),
bs AS (SELECT doc_id, b.label, i AS s FROM (SELECT doc_id, w, j, unnest(range(0, len(w))) AS i FROM d2 WHERE len(w) > 0) x, b
  WHERE contains(j, b.phrase) AND array_to_string(w[i + 1 : i + b.n], ' ') = b.phrase),
h0 AS (SELECT doc_id, r.*, string_split(regexp_replace(jj, '(' || pattern || ') ', chr(1) || '\\1' || chr(2) || ' ', 'g'), chr(1)) AS parts FROM d2, r WHERE regexp_matches(jj, pattern || ' ')),
h1 AS (SELECT doc_id, place, label, priority, score, parts, unnest(range(2, len(parts) + 1)) AS k FROM h0),
h AS (SELECT doc_id, place, label, priority, score, len(regexp_extract_all(array_to_string(parts[1 : k - 1], ''), '[^ ]+')) AS s,
  len(regexp_extract_all(string_split(parts[k], chr(2))[1], '[^ ]+')) AS n FROM h1),
h2 AS (SELECT doc_id, place, label, priority, score, s, s + n AS e FROM h),
kept AS (SELECT * FROM h2 d WHERE NOT EXISTS (SELECT 1 FROM h2 x WHERE x.doc_id = d.doc_id AND x.s <= d.s AND x.e >= d.e
  AND (x.priority < d.priority OR (x.priority = d.priority AND ((x.e - x.s) > (d.e - d.s) OR x.place < d.place))))),
ba AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM bs GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM bs) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bs UNION SELECT doc_id, label FROM kept) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(sc.score, 0.0) END AS DOUBLE) AS score
FROM d2 d LEFT JOIN ba USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)"""


SQL = sql()

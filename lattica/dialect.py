"""Functions of the dialect in SQL text: each call is rewritten to an expression of built-in functions.

Names that the dialect shares with Spark take the dialect's meaning: CONCAT takes null as empty, LPAD and RPAD never
shorten, INITCAP puts single blanks between words, MOD by zero and roots of negative numbers are null, ROUND and TRUNC
without digits give whole numbers, texts that are no dates give null. Quoted text is left alone.
"""

from __future__ import annotations

import re

from .functions import neuro, scalar

_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`")
_NAME = re.compile(r"[A-Za-z_]\w*")


def split(text: str, sep: str = ",") -> list[str]:
    """Parts of a list, outside quotes and parentheses."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        if m := _QUOTED.match(text, i):
            i = m.end()
            continue
        depth += (text[i] == "(") - (text[i] == ")")
        if text[i] == sep and not depth:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    last = text[start:].strip()
    return [*out, last] if last else out


def outside_quotes(text: str, pattern: str, put) -> str:
    """text with matches of a pattern that stand outside quotes replaced by put(match)."""
    both = re.compile(f"{_QUOTED.pattern}|({pattern})")
    return both.sub(lambda m: m[0] if m[1] is None else put(re.fullmatch(pattern, m[1])), text)


def _closing(text: str, at: int) -> int:
    """The place of the parenthesis that closes the one at `at`."""
    depth = 0
    while at < len(text):
        if m := _QUOTED.match(text, at):
            at = m.end()
            continue
        depth += (text[at] == "(") - (text[at] == ")")
        if not depth:
            return at
        at += 1
    raise ValueError("a parenthesis is not closed")


def _moment(x: str) -> str:
    return f"try_to_timestamp(CAST({x} AS STRING))"


def _part(function: str):
    return lambda *a: f"{function}({_moment(a[0]) if a else 'current_timestamp()'})"


def _padded(side: str):
    return lambda s, n, pad="' '": f"CASE WHEN length({s}) >= {n} THEN {s} ELSE {side}({s}, {n}, {pad}) END"


def _cut(x: str, digits: str = "0") -> str | None:
    if digits.startswith("'") or x.startswith("'"):
        return None  # the truncation of dates
    scaled = f"({x}) * power(10, {digits})"
    whole = f"CASE WHEN ({x}) < 0 THEN ceil({scaled}) ELSE floor({scaled}) END"
    return f"CAST({whole} AS BIGINT)" if digits == "0" else f"({whole} / power(10, {digits}))"


def _shifted(sign: str):
    def shift(x: str, by: str) -> str | None:
        m = re.fullmatch(r"INTERVAL\s+'?(-?\d+)'?\s+(\w+?)S?", by, re.I)
        return f"timestampadd({m[2].upper()}, {sign}{m[1]}, {_moment(x)})" if m else None

    return shift


def _formatted(x: str, pattern: str) -> str | None:
    if "%" not in pattern or not pattern.startswith("'"):
        return None
    java = scalar.java_pattern(pattern[1:-1].replace("''", "'")).replace("'", "\\'")
    return f"date_format({_moment(x)}, '{java}')"


def _weight(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 0D WHEN typeof({x}) = 'boolean' THEN IF(CAST({x} AS STRING) = 'true', 1D, 0D) "
        f"WHEN typeof({x}) = 'string' THEN pmod(xxhash64({x}), 1000) / 1000D WHEN typeof({x}) = 'binary' THEN octet_length(CAST({x} AS STRING)) % 100 / 100D "
        f"ELSE 1 / (1 + exp(-try_cast(CAST({x} AS STRING) AS DOUBLE) / 100)) END"
    )


def _joint(a: str, b: str | None = None, rate: str = "1.0D") -> str:
    b = a if b is None else b
    numbers = f"{_weight(a)} * ({_weight(b)}) * CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5D WHEN CAST({a} AS STRING) = CAST({b} AS STRING) THEN 1.2D ELSE 1D END"
    texts = f"coalesce({neuro.neuromatch_sql(a, b)}, 0D)"
    return f"(least(1D, greatest(0D, IF(typeof({a}) = 'string' AND typeof({b}) = 'string', {texts}, {numbers}))) * least(1D, greatest(0D, {rate})))"


def _utc(kind: str) -> str:
    return {"date": "to_date({0})", "time": "date_format({0}, 'HH:mm:ss')", "timestamp": "{0}"}[kind].format("to_utc_timestamp(current_timestamp(), current_timezone())")


_SPACES = r"\\s"
MACROS = {
    "LEN": lambda s: f"length({s})",
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})",
    "INITCAP": lambda s: f"initcap(regexp_replace(trim({s}), '{_SPACES}+', ' '))",
    "LPAD": _padded("lpad"),
    "RPAD": _padded("rpad"),
    "TRIM": lambda s: None if re.search(r"\bFROM\b", s, re.I) else f"regexp_replace({s}, '^{_SPACES}++|(?<!{_SPACES}){_SPACES}++$', '')",
    "LTRIM": lambda s: f"regexp_replace({s}, '^{_SPACES}++', '')",
    "RTRIM": lambda s: f"regexp_replace({s}, '(?<!{_SPACES}){_SPACES}++$', '')",
    "SUBSTRING": lambda s, a=None, n=None: None if a is None else f"substring({s}, greatest(1, {a}), {n or f'length({s})'})",
    "POSITION": lambda h, n=None: None if n is None else f"instr({h}, {n})",
    "MOD": lambda a, b: f"try_mod({a}, {b})",
    "SQRT": lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END",
    "SIGN": lambda x: f"CAST(signum({x}) AS BIGINT)",
    "ROUND": lambda x, d=None: f"CAST(round({x}) AS BIGINT)" if d is None else f"round({x}, {d})",
    "TRUNCATE": _cut,
    "TRUNC": _cut,
    "LOG": lambda x, y=None: f"ln({x})" if y is None else None,
    "RANDOM": lambda: "rand()",
    "NOW": lambda: "current_timestamp()",
    "GETDATE": lambda: "current_timestamp()",
    "SYSDATE": lambda: "current_timestamp()",
    "CURDATE": lambda: "current_date()",
    "CURTIME": lambda: "date_format(current_timestamp(), 'HH:mm:ss')",
    "LOCALTIME": lambda: "localtimestamp()",
    "UTC_DATE": lambda: _utc("date"),
    "UTC_TIME": lambda: _utc("time"),
    "UTC_TIMESTAMP": lambda: _utc("timestamp"),
    "EPOCH": lambda *a: f"unix_seconds({_moment(a[0])})" if a else "unix_timestamp()",
    "WEEKDAY": _part("dayofweek"),
    "WEEK": _part("weekofyear"),
    "DAYOFMONTH": _part("day"),
    **{f: _part(f.lower()) for f in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DAYOFWEEK", "DAYOFYEAR", "WEEKOFYEAR", "QUARTER")},
    "DATE_ADD": _shifted(""),
    "DATE_SUB": _shifted("-"),
    "DATE_FORMAT": _formatted,
    "STRFTIME": _formatted,
    "EXTRACT": lambda x: f"unix_seconds({_moment(m[1])})" if (m := re.fullmatch(r"EPOCH\s+FROM\s+(.*)", x, re.I | re.S)) else None,
    "NEUROMATCH": neuro.neuromatch_sql,
    "SYNAPTIC_WEIGHT": lambda x: f"({_weight(x)})",
    "HEBBIAN_LEARNING": _joint,
    "QUANTUM_SEARCH": lambda x, p: f"IF(contains(lower(CAST({x} AS STRING)), lower({p})), 1D, 0D)",
}
MACROS["SUBSTR"] = MACROS["SUBSTRING"]


_OPERAND = rf"(?:{_NAME.pattern}(?:\.{_NAME.pattern})?|'(?:[^']|'')*')"
_SIMILAR = re.compile(rf"(?<![\w'.])({_OPERAND})\s+(?:(NOT)\s+)?SYNAPTIC_SIMILAR\s+({_OPERAND})", re.I)


def rewritten(text: str) -> str:
    """SQL text with the dialect's calls as expressions of built-in functions; `a SYNAPTIC_SIMILAR b` is a match of default strength."""
    text = _SIMILAR.sub(lambda m: f"{(m[2] or '') and 'NOT '}(NEUROMATCH({m[1]}, {m[3]}) >= {neuro.DEFAULT_STRENGTH}D)", text)
    out, i = [], 0
    while i < len(text):
        if m := _QUOTED.match(text, i):
            out.append(m[0])
            i = m.end()
        elif m := _NAME.match(text, i):
            i = m.end()
            gap = re.compile(r"\s*").match(text, i).end()
            if m[0].upper() in MACROS and text[gap : gap + 1] == "(":
                end = _closing(text, gap)
                given = [rewritten(x) for x in split(text[gap + 1 : end])]
                made = MACROS[m[0].upper()](*given)
                out.append(f"{m[0]}({', '.join(given)})" if made is None else made)
                i = end + 1
            else:
                out.append(m[0])
        else:
            out.append(text[i])
            i += 1
    return "".join(out)

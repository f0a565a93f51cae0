"""Scalar functions: string, null, mathematical and date functions as Column expressions.

Bad input gives null rather than an error: a remainder by zero, roots and logarithms outside their domain, texts that are
no dates. CONCAT takes null as empty; LPAD and RPAD never shorten; INITCAP puts single blanks between words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    return F.concat_ws("", *[p.cast("string") for p in parts])


def initcap(s: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(s), r"\s+", " "))


def lpad(s: Column, n: int, pad: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, pad))


def rpad(s: Column, n: int, pad: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, pad))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s++|(?<!\s)\s++\z", "")


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """1-based; a start below 1 is 1."""
    start = max(1, start)
    return F.substring(s, F.lit(start), F.lit(length) if length is not None else F.length(s))


def position(haystack: Column, needle: str) -> Column:
    return F.instr(haystack, needle)


def ascii_code(s: Column) -> Column:
    return F.ascii(s)


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def round_half_away(x: Column, digits: int = 0) -> Column:
    r = F.round(x, digits)
    return r if digits else r.cast("long")


def truncate(x: Column, digits: int = 0) -> Column:
    scaled = x * 10**digits
    t = F.when(x < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return t / 10**digits if digits else t.cast("long")


def power(a: Column, b: Column) -> Column:
    return F.power(a, b)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


# Strftime directives and their date patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE"}


def timestamp(x: Column) -> Column:
    """A date, timestamp or text as a timestamp; null where a text is neither."""
    return F.try_to_timestamp(x.cast("string"))


def java_pattern(pattern: str) -> str:
    """The date pattern of a strftime one."""
    java, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 2] in STRFTIME:
            java, i = java + STRFTIME[pattern[i : i + 2]], i + 2
        else:
            java, i = java + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return java


def date_format(x: Column, pattern: str) -> Column:
    return F.date_format(x, java_pattern(pattern))


def date_add(x: Column, n: int, unit: str) -> Column:
    """x moved by n units; a month's last day holds where the month is shorter."""
    return F.timestamp_add(unit.upper().rstrip("S"), F.lit(n), x)


def datediff(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def extract(field: str, x: Column) -> Column:
    """Day of week counts from Sunday, 1; week is the ISO one."""
    own = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOW": F.dayofweek, "DAYOFWEEK": F.dayofweek, "DOY": F.dayofyear, "DAYOFYEAR": F.dayofyear, "WEEK": F.weekofyear, "QUARTER": F.quarter, "EPOCH": lambda v: F.unix_seconds(v.cast("timestamp"))}
    return own[field.upper()](x)

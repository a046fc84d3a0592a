"""Text expressions: everything is a Column of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import SUFFIXES

FLAGS = "(?iuU)"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))


def _one_way(pattern: str) -> bool:
    """Whether the pattern has no alternative outside of groups, classes and escapes."""
    plain = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", plain)) != plain:
        plain = inner
    return "|" not in plain


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found. Those that start at a word's edge share one test of it, so that most places cost one try."""
    edge = [p[2:] for p in patterns if p.startswith("\\b") and _one_way(p)]
    rest = [p for p in patterns if not (p.startswith("\\b") and _one_way(p))]
    both = ([f"\\b(?:{'|'.join(edge)})"] if edge else []) + [f"(?:{p})" for p in rest]
    return text.rlike(FLAGS + "|".join(both))


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first matching pattern matches; null without a match. One alternation decides whether any is tried.

    Then each pattern in turn looks ahead from the start of the text, and the one that finds something names its group:
    one expression a list, which keeps generated code small."""
    ahead = "|".join(f"(?=(?s:.*?)(?<h{k}>{p}))" for k, p in enumerate(patterns))
    found = F.regexp_replace(text, f"{FLAGS}^(?:{ahead})(?s:.*)$", "".join(f"${{h{k}}}" for k in range(len(patterns))))
    return F.when(any_match(text, patterns), found)


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def entity_key(name: Column) -> Column:
    """Lower case without the company suffix at the end and without punctuation."""
    plain = F.regexp_replace(F.trim(F.lower(name)), f"\\b({'|'.join(SUFFIXES)})\\.?$", "")
    return F.trim(F.regexp_replace(plain, "(?U)[^\\w\\s]", ""))


def timestamp(text: Column) -> Column:
    """The first format that fits: ISO forms, compact news stamps, then day-first before month-first dates."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMddHHmmssX", "yyyyMMddHHmmss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _fixed(x: Column, places: int) -> Column:
    """A double >= 0 with commas and so many decimal places, rounded by its exact binary value, half to even, as C does.

    format_string rounds the shortest decimal that stands for the double, half up: 318.325 becomes 318.33 though the
    double lies below it.  Here the fraction is counted in units of 2^-62, which is exact from 2^-10 on, and less than that
    rounds to 0; from 2^53 on there is no fraction."""
    scale, whole_number = 10**places, lambda c: c.cast("decimal(19,0)")
    small = F.when(x < 2.0**53, x).otherwise(0.0)
    whole = F.floor(small)
    part = small - whole
    k = F.floor(part * scale)  # at most one too large, and then the part lies below its middle
    twice = whole_number((part * 2.0**62).cast("long")) * F.lit(2 * scale).cast("decimal(4,0)")
    middle = whole_number(2 * k + 1) * whole_number(F.lit(2**62))
    digits = k + ((twice > middle) | ((twice == middle) & (k % 2 == 1))).cast("long")
    full = digits == scale
    text = F.format_string(f"%,d.%0{places}d", whole + full.cast("long"), F.when(full, 0).otherwise(digits))
    large = F.when(x.between(2.0**53, 1e37), x).otherwise(0.0)
    high = F.floor(large / 2.0**62)
    exact = whole_number(high) * whole_number(F.lit(2**62)) + whole_number((large - high * 2.0**62).cast("long"))
    beyond = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").otherwise(F.format_string(f"%,.{places}f", x))
    return F.when(x < 2.0**53, text).when(x <= 1e37, F.concat(F.format_number(exact, 0), F.lit("." + "0" * places))).when(x.isNotNull(), beyond)


def money(x: Column) -> Column:
    """$2.295M and the like; the sign stands first."""
    size = F.abs(x).cast("double")
    short = lambda c, places, unit: F.concat(F.lit("$"), _fixed(c, places), F.lit(unit))
    form = F.when(size >= 1e9, short(size / 1e9, 3, "B")).when(size >= 1e6, short(size / 1e6, 3, "M")).when(size >= 1e3, short(size / 1e3, 3, "K")).otherwise(short(size, 2, ""))
    return F.concat(F.when(x < 0, "-").otherwise(""), form)

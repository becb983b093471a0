"""The transforms of a recipe's fields, and chains of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

NUMBER = r"-?\d+(?:[.,]\d+)*"
# Date notations, tried in turn, and whether they carry a time.
DATES = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd", "yyyy.MM.dd", "dd/MM/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy'년' MM'월' dd'일'"]


def _found(text: Column, regex: str, group: int = 0) -> Column:
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, group))


def trim(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def normalize_ws(v: Column) -> Column:
    return trim(F.regexp_replace(v, r"(?U)\s+", " "))


def strip_html(v: Column) -> Column:
    return normalize_ws(F.regexp_replace(v, "<[^>]+>", " "))


def to_number(v: Column) -> Column:
    """The first number of a text as a double. A last group of one or two digits behind a separator that
    occurs once is a fraction; other separators group thousands."""
    raw = _found(v, NUMBER)
    tail = F.regexp_extract(raw, r"([.,])(\d{1,2})$", 2)
    mark = F.regexp_extract(raw, r"([.,])(\d{1,2})$", 1)
    once = (tail != "") & (F.length(raw) - F.length(F.replace(raw, mark, F.lit(""))) == 1)
    whole = F.regexp_replace(F.regexp_replace(raw, r"[.,]\d{1,2}$", ""), "[.,]", "")
    return F.when(once, F.concat(whole, F.lit("."), tail)).otherwise(F.regexp_replace(raw, "[.,]", "")).try_cast("double")


def to_int(v: Column) -> Column:
    return to_number(v).try_cast("long")


def duration_to_seconds(v: Column) -> Column:
    """Seconds of H:MM:SS, MM:SS or an ISO 8601 duration without years and months."""
    text = F.trim(v)
    clock, iso = r"^(?:(\d+):)?(\d{1,2}):(\d{2})$", r"(?i)^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    n = lambda regex, g: F.coalesce(F.nullif(F.regexp_extract(text, regex, g), F.lit("")).cast("double"), F.lit(0.0))
    from_clock = n(clock, 1) * 3600 + n(clock, 2) * 60 + n(clock, 3)
    from_iso = n(iso, 1) * 86400 + n(iso, 2) * 3600 + n(iso, 3) * 60 + n(iso, 4)
    return F.when(text.rlike(clock), from_clock).when(text.rlike(iso) & text.rlike(r"\d"), from_iso).cast("long")


def parse_date(v: Column) -> Column:
    """A date as ISO 8601 text: what already is stays, other notations are taken as UTC; null otherwise."""
    text = F.trim(v)
    iso = F.regexp_replace(F.replace(text, F.lit("Z"), F.lit("+00:00")), r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    whole = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(iso, F.lit("T00:00:00"))).when(iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}([+-]\d{2}:\d{2})?$"), F.regexp_replace(iso, r"(T\d{2}:\d{2})", "$1:00")).otherwise(iso)
    known = whole.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6})?([+-]\d{2}:\d{2})?$") & F.try_to_timestamp(whole).isNotNull()
    other = F.coalesce(*[F.when(F.length(text) >= 8, F.try_to_timestamp(text, F.lit(d))) for d in DATES])
    return F.when(known, whole).otherwise(F.date_format(other, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def regex_extract(v: Column, regex: str = "", group: str = "0", *_: str) -> Column:
    """A group of the first match; null without one, or where the expression has no such group."""
    try:
        groups = re.compile(regex).groups
    except re.error:
        return F.lit(None).cast("string")
    n = int(group) if group.isdigit() else 0
    return _found(v, regex, n) if regex and n <= groups else F.lit(None).cast("string")


def split(v: Column, by: str = "", index: str = "0", *_: str) -> Column:
    """A part of a text, from the end if the index is negative; null if there is none, or no separator."""
    if not by:
        return F.lit(None).cast("string")
    n = int(index) if index.lstrip("-").isdigit() else 0
    return F.try_element_at(F.split(v, re.sub(r"([^\w\s])", r"\\\1", by), -1), F.lit(n + 1 if n >= 0 else n))


def default(v: Column, value: str | None = None, *_: str) -> Column:
    return F.when(v.isNull() | (v.cast("string") == ""), F.lit(value)).otherwise(v.cast("string"))


PLAIN = {
    "trim": trim, "normalize_ws": normalize_ws, "lower": F.lower, "upper": F.upper, "strip_html": strip_html, "to_number": to_number, "to_int": to_int, "to_float": to_number,
    "duration_to_seconds": duration_to_seconds, "parse_date": parse_date,
}
WITH_ARGUMENTS = {"regex_extract": regex_extract, "split": split, "default": default}


def check(steps: list[str]) -> None:
    """Raises an error on the name of an unknown transform; needs no session."""
    known = sorted([*PLAIN, *WITH_ARGUMENTS, "to_absolute_url"])
    for step in steps:
        if step.strip().partition("(")[0] not in known:
            raise ValueError(f"unknown transform {step!r}; there are: {', '.join(known)}")


def chain(v: Column, steps: list[str], base: Column | None = None) -> Column:
    """Applies transforms such as ``split(/, 1)`` from left to right; an unknown name is an error."""
    check(steps)
    for step in steps:
        name, _, rest = step.strip().partition("(")
        args = [a.strip().strip("\"'") for a in rest.rstrip()[:-1].split(",")] if rest.rstrip().endswith(")") and rest.rstrip() != ")" else []
        if name == "to_absolute_url":
            v = urls.join(base, v) if base is not None else F.when(F.trim(v) != "", v)
        elif name in WITH_ARGUMENTS:
            v = WITH_ARGUMENTS[name](v, *args)
        else:
            v = PLAIN[name](v.cast("string"))
    return v


def shape(v: Column) -> Column:
    """The coarse type of a text value, for consistency."""
    digits = F.regexp_replace(v, "[,.-]", "")
    return (
        F.when(v.isNull() | (v == ""), "empty").when(v.rlike("^(https?://|/)"), "url").when(digits.rlike(r"^\d+$"), "numeric-text")
        .when(F.length(v) > 200, "long-text").otherwise("text")
    )

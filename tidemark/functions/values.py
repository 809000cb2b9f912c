"""Dates, vectors and small reductions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity of exit codes, worst last; any other code is worse than these.
SEVERITY = {0: 0, 3: 1, 2: 2, 1: 3}


def compact_date(text: Column) -> Column:
    """yyyymmdd to a date; an impossible or malformed one is null."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour blocks between two timestamps."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def full_year(two_digits: Column) -> Column:
    return F.when(two_digits >= 90, two_digits + 1900).otherwise(two_digits + 2000)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector is an error."""
    n = F.sqrt(dot(v, v))
    safe = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a vector of length 0")).cast("double"))
    return F.transform(v, lambda x: x.cast("double") / safe)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, rounded to 6 digits so that engines agree; never minus zero."""
    return F.round(1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6) + F.lit(0.0)


def severity(code: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for c, rank in SEVERITY.items():
        out = F.when(code == c, rank).otherwise(out)
    return out

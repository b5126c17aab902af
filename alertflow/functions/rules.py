"""Small row rules shared by several jobs: ranks, buckets, look-ups, text joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity rank of a log level; anything else ranks as INFO.
LEVEL_RANK = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4, "FATAL": 5}
# Lower score bound of each alert severity, highest first.
SEVERITY_THRESHOLDS = {"CRITICAL": 0.9, "HIGH": 0.7, "MEDIUM": 0.5, "LOW": 0.3}
# Chat colour of each severity.
SEVERITY_COLOUR = {
    "CRITICAL": "#FF0000", "HIGH": "#FF8C00", "MEDIUM": "#FFD700", "LOW": "#32CD32", "INFO": "#1E90FF",
}


def lookup(key: Column, table: Mapping, default) -> Column:
    """A constant look-up table as one CASE expression."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    return lookup(level, LEVEL_RANK, 2)


def severity(score: Column, thresholds: Mapping[str, float] = SEVERITY_THRESHOLDS) -> Column:
    out = F.lit("INFO")
    for name, bound in sorted(thresholds.items(), key=lambda kv: kv[1]):
        out = F.when(score >= F.lit(float(bound)), F.lit(name)).otherwise(out)
    return out


def severity_colour(sev: Column) -> Column:
    return lookup(sev, SEVERITY_COLOUR, None)


def http_class(status: Column) -> Column:
    return (
        F.when(status >= 500, 4)
        .when(status >= 400, 3)
        .when(status >= 300, 2)
        .when(status >= 200, 1)
        .otherwise(0)
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def text_or_null(value: Column) -> Column:
    """String form in which a missing value prints as the word null."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def plain_double(value: Column) -> Column:
    """A double without exponent notation, always with a fraction digit."""
    whole = F.concat(value.cast("decimal(25,0)").cast("string"), F.lit(".0"))
    fraction = F.regexp_replace(value.cast("decimal(30,6)").cast("string"), "0+$", "")
    large = F.when(value == F.floor(value), whole).otherwise(fraction)
    return F.when(F.abs(value) < F.lit(1e7), value.cast("string")).otherwise(large)


def short_hash(value: Column, digits: int = 16) -> Column:
    """First hex digits of SHA-256: 16 digits are 64 bits, so ids stay distinct at billions of rows."""
    return F.substring(F.sha2(value, 256), 1, digits)


def template(text: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{{ name }}`` place-holders."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{ " + name + " }}"), text_or_null(value))
    return out

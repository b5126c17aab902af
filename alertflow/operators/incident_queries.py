"""Look-ups, filtered listings, paging and text search over incidents and summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(**wanted) -> Column:
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def by_alert(incidents: DataFrame, alert_id: str) -> DataFrame:
    return incidents.filter(_same(alert_id=alert_id))


def by_fields(incidents: DataFrame, **wanted) -> DataFrame:
    """Equality on any columns, e.g. ``service_name=..., status=...``."""
    return incidents.filter(_same(**wanted))


def created_between(incidents: DataFrame, start, end, service: str | None = None) -> DataFrame:
    """Both ends excluded."""
    hit = (F.col("created_at") > F.lit(start)) & (F.col("created_at") < F.lit(end))
    return incidents.filter(hit if service is None else hit & _same(service_name=service))


def created_in(incidents: DataFrame, start, end, **wanted) -> DataFrame:
    """Start included, end excluded."""
    hit = (F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end))
    return incidents.filter(hit & _same(**wanted))


def score_at_least(incidents: DataFrame, score: float) -> DataFrame:
    return incidents.filter(F.col("anomaly_score") >= F.lit(float(score)))


def assigned_to(incidents: DataFrame, assignee: str, statuses: Sequence[str]) -> DataFrame:
    return incidents.filter(_same(assignee=assignee) & F.col("status").isin(*statuses))


def count_in(incidents: DataFrame, service: str, start, end) -> DataFrame:
    return created_in(incidents, start, end, service_name=service).agg(F.count("*").alias("incidents"))


def closed_before(incidents: DataFrame, cutoff, status: str = "CLOSED") -> DataFrame:
    return incidents.filter(_same(status=status) & (F.col("created_at") < F.lit(cutoff)))


def find_incidents(
    incidents: DataFrame,
    service: str | None = None,
    status: str | None = None,
    severity: str | None = None,
    start=None,
    end=None,
    mode: str = "first_match",
) -> DataFrame:
    """Listing filter. ``first_match`` applies only the first complete combination of
    arguments; ``all`` applies every argument given."""
    ranged = start is not None and end is not None
    given = {
        n: v for n, v in (("service_name", service), ("status", status), ("severity", severity)) if v is not None
    }
    if mode == "all":
        out = by_fields(incidents, **given)
        return created_between(out, start, end) if ranged else out
    if mode != "first_match":
        raise ValueError(f"unknown mode {mode!r}")
    choices = (
        (("service_name", "status"), False),
        (("service_name",), True),
        (("service_name",), False),
        (("status",), False),
        (("severity",), False),
        ((), True),
    )
    for names, needs_range in choices:
        if all(n in given for n in names) and (ranged or not needs_range):
            out = by_fields(incidents, **{n: given[n] for n in names})
            return created_between(out, start, end) if needs_range else out
    return incidents


def page(incidents: DataFrame, number: int = 0, size: int = 20, after: tuple | None = None) -> DataFrame:
    """Newest first. ``after=(created_at, alert_id)`` continues below a known row, which
    stays cheap however deep the listing goes; a page number costs all pages before it."""
    order = [F.desc("created_at"), F.asc("alert_id")]
    if after is not None:
        ts, alert = F.lit(after[0]), F.lit(after[1])
        below = (F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("alert_id") > alert))
        return incidents.filter(below).orderBy(*order).limit(size)
    return incidents.orderBy(*order).offset(number * size).limit(size)


def total(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count("*").alias("total_elements"))


def newest(incidents: DataFrame, limit: int = 10) -> DataFrame:
    return page(incidents, 0, limit)


SEARCHED = ("title", "description")


def search_tokens(columns: Sequence[str] = SEARCHED, reasons: str | None = "anomaly_reasons") -> Column:
    """Lower-case words of the searched columns; write it as a column when searching often."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    if reasons:
        texts.append(F.coalesce(F.array_join(reasons, " "), F.lit("")))
    return F.split(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{N}_]+")


def parse_query(query: str) -> tuple[list[str], list[str], list[str]]:
    """Lower-case phrases, plain words and excluded words."""
    text = query.lower()
    phrases = [p for p in re.findall(r'"([^"]+)"', text) if p.strip()]
    rest = re.sub(r'"[^"]*"', " ", text).split()
    banned = [w[1:] for w in rest if w.startswith("-") and len(w) > 1]
    return phrases, [t for w in rest if not w.startswith("-") for t in re.findall(r"\w+", w)], banned


def holds_phrase(phrase: str, columns: Sequence[str], reasons: str | None) -> Column:
    """The lower-case phrase is a part of one of the searched texts."""
    parts = [F.coalesce(F.lower(c), F.lit("")) for c in columns]
    if reasons:
        parts.append(F.lower(F.coalesce(F.array_join(reasons, " "), F.lit(""))))
    found = F.lit(False)
    for part in parts:
        found = found | part.contains(phrase)
    return found


def text_search(
    incidents: DataFrame,
    query: str,
    columns: Sequence[str] = SEARCHED,
    reasons: str | None = "anomaly_reasons",
    limit: int | None = None,
) -> DataFrame:
    """Any plain word matches; quoted phrases must all occur; ``-word`` excludes. No stemming."""
    phrases, words, banned = parse_query(query)
    hay = search_tokens(columns, reasons)
    hit = F.lit(True) if phrases else (F.arrays_overlap(hay, _words(words)) if words else F.lit(False))
    for p in phrases:
        hit = hit & holds_phrase(p, columns, reasons)
    if banned:
        hit = hit & ~F.arrays_overlap(hay, _words(banned))
    out = incidents.filter(hit)
    return out if limit is None else newest(out, limit)


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


# -- summaries ---------------------------------------------------------------


def summary_of_window(summaries: DataFrame, service: str, start, end) -> DataFrame:
    return summaries.filter(
        _same(service_name=service) & (F.col("window_start") == F.lit(start)) & (F.col("window_end") == F.lit(end))
    )


def summaries_between(summaries: DataFrame, start, end, service: str | None = None) -> DataFrame:
    """Window start strictly inside the range."""
    hit = (F.col("window_start") > F.lit(start)) & (F.col("window_start") < F.lit(end))
    return summaries.filter(hit if service is None else hit & _same(service_name=service))


def summaries_in(summaries: DataFrame, start, end) -> DataFrame:
    return summaries.filter((F.col("window_start") >= F.lit(start)) & (F.col("window_start") < F.lit(end)))


def summaries_from(summaries: DataFrame, service: str, start) -> DataFrame:
    return summaries.filter(_same(service_name=service) & (F.col("window_start") >= F.lit(start)))


def newest_summaries(summaries: DataFrame, limit: int = 10) -> DataFrame:
    """Newest windows per service; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy("service_name").orderBy(F.desc("window_start"))
    return summaries.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def summary_counts(summaries: DataFrame, start, end) -> DataFrame:
    return summaries_in(summaries, start, end).select("service_name", "total_incidents", "critical_incidents")

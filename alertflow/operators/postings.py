"""Text search through an inverted table: token to incident, in buckets by token, kept up to date batch by batch."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.operators import incident_queries as iq

BUCKETS = 256


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(incidents: DataFrame, columns: Sequence[str] = iq.SEARCHED, reasons: str | None = "anomaly_reasons") -> DataFrame:
    """``bucket``, ``token`` and ``alert_id``, one row for each different token of an incident; empty tokens are left out."""
    tokens = F.array_remove(F.array_distinct(iq.search_tokens(columns, reasons)), "")
    rows = incidents.select("alert_id", F.explode(tokens).alias("token"))
    return rows.select(bucket_of(F.col("token")).alias("bucket"), "token", "alert_id")


def write_postings(incidents: DataFrame, path: str, batch: int = 0, **texts) -> None:
    """Postings and versions of the incidents of one batch, each at most once in it.

    A batch owns its folders, so a repeated batch replaces itself. ``versions`` says which batch wrote an incident last;
    postings of earlier batches are stale and never found again. Postings are dealt by bucket, and a bucket's rows by a
    hash of the incident as well, so that the bucket of a very frequent word is several tasks.
    """
    incidents.select("alert_id").write.mode("overwrite").parquet(f"{path}/versions/batch={batch}")
    rows = postings(incidents, **texts).repartition("bucket", F.pmod(F.xxhash64("alert_id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")


class Postings:
    """The tables that ``write_postings`` wrote below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        schema = "token string, alert_id string, batch bigint, bucket int"
        self.rows = spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(f"{path}/postings")
        versions = spark.read.schema("alert_id string, batch bigint").parquet(f"{path}/versions")
        self.current = versions.groupBy("alert_id").agg(F.max("batch").alias("batch"))

    def having(self, tokens: Sequence[str]) -> DataFrame:
        """``alert_id``, ``batch`` and ``token`` of the tokens, from their buckets alone."""
        spark = self.rows.sparkSession
        wanted = sorted(set(tokens))
        found = spark.createDataFrame([(t,) for t in wanted] or [("",)], "token string").select(bucket_of(F.col("token")))
        # as literals, so that the scan lists those folders only
        buckets = sorted({r[0] for r in found.collect()})
        return self.rows.filter(F.col("bucket").isin(buckets) & F.col("token").isin(wanted)).select("alert_id", "batch", "token")

    def matching(self, condition: Column) -> DataFrame:
        """As ``having``, by a condition on ``token``: reads every token, but no text."""
        return self.rows.filter(condition).select("alert_id", "batch", "token")


def _candidates(index: Postings, phrase: str) -> DataFrame:
    """Incidents that may hold the phrase: its inner words whole, or else an outer one as the part of a token.

    A phrase is found as a part of the text, so its first word may end a longer token and its last may begin one.
    """
    parts = re.split(r"[^\w]+", phrase)
    whole = [p for p in parts[1:-1] if p]
    if whole:
        hits = index.having(whole)
        counted = hits.groupBy("alert_id", "batch").agg(F.count_distinct("token").alias("n"))
        return counted.filter(F.col("n") == len(set(whole))).select("alert_id", "batch")
    first, last = parts[0], parts[-1]
    token = F.col("token")
    if len(parts) == 1:
        hits = index.matching(token.contains(first))
    elif first or last:
        hits = index.matching(token.endswith(first) if len(first) >= len(last) else token.startswith(last))
    else:
        return index.current.select("alert_id", "batch")
    return hits.select("alert_id", "batch").distinct()


def search(
    incidents: DataFrame,
    index: Postings,
    query: str,
    columns: Sequence[str] = iq.SEARCHED,
    reasons: str | None = "anomaly_reasons",
    limit: int | None = None,
) -> DataFrame:
    """What ``text_search`` gives, from the postings: texts are read only of incidents that may hold a phrase."""
    phrases, words, banned = iq.parse_query(query)
    if phrases:
        hits = [_candidates(index, p) for p in phrases]
    elif words:
        hits = [index.having(words).select("alert_id", "batch").distinct()]
    else:
        return incidents.limit(0)
    named = hits[0]
    for more in hits[1:]:
        named = named.join(more, ["alert_id", "batch"], "left_semi")
    if banned:
        named = named.join(index.having(banned), ["alert_id", "batch"], "left_anti")
    named = named.join(index.current, ["alert_id", "batch"], "left_semi")
    out = incidents.join(named.select("alert_id"), "alert_id", "left_semi")
    for p in phrases:
        out = out.filter(iq.holds_phrase(p, columns, reasons))
    return out if limit is None else iq.newest(out, limit)

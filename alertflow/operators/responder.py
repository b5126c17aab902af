"""Planned response actions: matching rules, exclusions, cooldown, dry-run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions import rules
from alertflow.operators import suppress

# Services that may be acted on, services that never are, and score bounds.
SERVICE_PATTERNS = ("order-service.*", "payment-service.*", "user-service.*")
EXCLUDED = ("database", "redis", "elasticsearch")
CRITICAL_SCORE, HIGH_SCORE = 0.9, 0.7
# Cooldown in seconds and actions per hour for each kind of action.
LIMITS = {"POD_RESTART": (900, 3), "SERVICE_SCALE_UP": (600, 10)}
MIN_REPLICAS, MAX_REPLICAS, MAX_FACTOR = 1, 10, 3


def _matches(patterns: Sequence[str]) -> Column:
    """Whole-name match against any pattern, as one regular expression."""
    return F.col("service_name").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$")


def plan_actions(
    alerts: DataFrame,
    patterns: Sequence[str] = SERVICE_PATTERNS,
    critical: float = CRITICAL_SCORE,
    high: float = HIGH_SCORE,
) -> DataFrame:
    """Alerts that call for an action: restart when critical, scale up when high.

    The pattern list is configuration: it becomes one filter, not a join.
    """
    return _with_action(alerts.filter(_matches(patterns)), critical, high)


def _with_action(alerts: DataFrame, critical: float, high: float) -> DataFrame:
    sev, score = F.col("severity"), F.col("anomaly_score")
    action = F.when((sev == "CRITICAL") & (score >= F.lit(critical)), F.lit("POD_RESTART")).when(
        (sev == "HIGH") & (score >= F.lit(high)), F.lit("SERVICE_SCALE_UP")
    )
    return alerts.withColumn("action_type", action).filter(F.col("action_type").isNotNull())


def literal_prefix(pattern: Column) -> Column:
    """What every name that matches the pattern begins with; empty where the pattern has an alternative."""
    start = F.regexp_extract(pattern, r"^((?:[\p{L}\p{Nd} _/-](?![*?+{]))*)", 1)
    return F.when(pattern.contains("|"), F.lit("")).otherwise(start)


def match_patterns(names: DataFrame, patterns: DataFrame, name: str = "service_name") -> DataFrame:
    """(name, pattern) of each distinct name and each pattern that it matches as a whole.

    A pattern meets only names that begin with its literal prefix: names are spread into their prefixes of the lengths
    that occur, joined on the prefix, and tested there. Patterns without a literal prefix meet every name. Null names and
    null patterns match nothing.
    """
    p = patterns.select("pattern").distinct().select("pattern", literal_prefix(F.col("pattern")).alias("_prefix"))
    p = p.filter(F.col("pattern").isNotNull()).withColumn("_n", F.length("_prefix"))
    lengths = p.agg(F.collect_set("_n").alias("v")).scalar()
    fits = F.filter("_lengths", lambda n: n <= F.length(name))
    each = names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("_lengths", lengths)
    spread = each.select(name, F.explode(F.transform(fits, lambda n: F.substring(F.col(name), F.lit(1), n))).alias("_prefix"))
    hit = F.rlike(F.col(name), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$")))
    return spread.join(p, "_prefix").filter(hit).select(name, "pattern")


def plan_actions_from(
    alerts: DataFrame, patterns: DataFrame, critical: float = CRITICAL_SCORE, high: float = HIGH_SCORE
) -> DataFrame:
    """As ``plan_actions`` with the service patterns as a table (``pattern``), of any length."""
    planned = _with_action(alerts, critical, high)
    wanted = match_patterns(planned, patterns).select("service_name").distinct()
    return planned.join(wanted, "service_name", "left_semi").select(*planned.columns)


def exclude_services(planned: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop actions on services listed in ``excluded`` (service_name)."""
    return planned.join(excluded.select("service_name").distinct(), "service_name", "left_anti")


def limit_actions(planned: DataFrame, cooldown_s: int, per_hour: int) -> DataFrame:
    """Cooldown after the last action taken on a service and an hourly bound."""
    keyed = planned.withColumn("_target", F.concat_ws("|", "action_type", "service_name"))
    return suppress.emit(keyed, cooldown_s, per_hour, key="_target", fingerprint="_target").drop("_target")


def limit_all(planned: DataFrame, limits: Mapping[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Every kind of action under its own cooldown and hourly bound."""
    parts = [limit_actions(planned.filter(F.col("action_type") == kind), *bound) for kind, bound in limits.items()]
    return reduce(DataFrame.unionByName, parts)


def target_replicas(current: Column, wanted: Column) -> Column:
    """Wanted size within the fixed bounds and at most ``MAX_FACTOR`` times the current one."""
    upper = F.least(F.lit(MAX_REPLICAS), current * MAX_FACTOR)
    return F.greatest(F.lit(MIN_REPLICAS), F.least(wanted, upper))


def action_records(planned: DataFrame, replicas: Column | None = None, dry_run: bool = True) -> DataFrame:
    """Action log rows. Nothing is executed here, so without dry run they stay PENDING."""
    service = rules.text_or_null(F.col("service_name"))
    size = (replicas if replicas is not None else F.lit(MIN_REPLICAS)).cast("string")
    scaled = F.concat(service, F.lit(" to "), size, F.lit(" replicas"))
    restart = F.col("action_type") == "POD_RESTART"
    if dry_run:
        text = F.when(restart, F.concat(F.lit("DRY RUN: Would restart pods for service: "), service)).otherwise(
            F.concat(F.lit("DRY RUN: Would scale service: "), scaled)
        )
    else:
        text = F.when(restart, F.concat(F.lit("Restarting pods for service: "), service)).otherwise(
            F.concat(F.lit("Scaling service: "), scaled)
        )
    return planned.select(
        rules.short_hash(F.concat_ws("|", "alert_id", "action_type")).alias("action_id"),
        "alert_id",
        "service_name",
        "action_type",
        F.lit("DRY_RUN" if dry_run else "PENDING").alias("status"),
        text.alias("description"),
        F.col("created_at").alias("executed_at"),
        F.lit(dry_run).alias("success"),
        F.lit(dry_run).alias("dry_run"),
    )

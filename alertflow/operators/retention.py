"""Retention: age limits, expiry and archiving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days a closed incident is kept per environment, and life times of the tables.
KEEP_DAYS = {"development": 30, "staging": 60, "production": 365, "default": 90}
ARCHIVE_DAYS = 180


def _days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"make_dt_interval({int(days)}, 0, 0, 0)")


def is_outdated(as_of: Column, days: int) -> Column:
    return (F.col("status") == "CLOSED") & (F.col("created_at") < _days_before(as_of, days))


def drop_old_closed(incidents: DataFrame, as_of: Column, days: int = KEEP_DAYS["default"]) -> DataFrame:
    """Incidents that survive the clean-up of closed ones older than ``days``."""
    return incidents.filter(~is_outdated(as_of, days))


def drop_expired(table: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose ``expires_at`` has not come yet."""
    return table.filter(F.col("expires_at") > as_of)


def archive_split(incidents: DataFrame, as_of: Column, days: int = ARCHIVE_DAYS) -> DataFrame:
    """Rows with ``store`` = archive or live and the day they are filed under."""
    old = F.col("created_at") < _days_before(as_of, days)
    return incidents.withColumns(
        {
            "store": F.when(old, F.lit("archive")).otherwise(F.lit("live")),
            "created_date": F.to_date("created_at"),
        }
    )


def write_days(incidents: DataFrame, path: str) -> None:
    """Replace the days present in ``incidents``; other days stay as they are."""
    (
        incidents.repartitionByRange("created_date", "service_name", "alert_id")
        .sortWithinPartitions("created_date", "service_name", "created_at")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("created_date")
        .parquet(path)
    )


def _delete_days(spark: SparkSession, path: str, days: list) -> None:
    for day in days:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/created_date={day}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def archive_old_days(spark: SparkSession, live: str, archive: str, as_of: Column, days: int = ARCHIVE_DAYS) -> None:
    """Copy every day that lies wholly before the limit to the archive, then drop it from the live table.

    Only the old day folders are read. A run that is repeated after a failure copies
    the same days again and ends in the same state.
    """
    table = spark.read.parquet(live)
    old = table.filter(F.col("created_date") < F.to_date(_days_before(as_of, days)))
    gone = [r.created_date for r in old.select("created_date").distinct().collect()]
    if gone:
        write_days(old, archive)
        _delete_days(spark, live, gone)


def clean_days(spark: SparkSession, path: str, as_of: Column, days: int = KEEP_DAYS["default"]) -> None:
    """Remove outdated closed incidents from a day-partitioned table.

    Days are the unit of work: those without an outdated row are not touched, those
    with nothing else are dropped, and only the others are rewritten.
    """
    table = spark.read.parquet(path).filter(F.col("created_date") <= F.to_date(_days_before(as_of, days)))
    dead = is_outdated(as_of, days)
    per_day = table.groupBy("created_date").agg(F.count_if(dead).alias("dead"), F.count("*").alias("n"))
    hit = per_day.filter(F.col("dead") > 0).collect()
    mixed = [r.created_date for r in hit if r.dead < r.n]
    if mixed:
        write_days(table.filter(F.col("created_date").isin(mixed) & ~dead), path)
    _delete_days(spark, path, [r.created_date for r in hit if r.dead == r.n])

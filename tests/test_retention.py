"""Clean-up and archiving of day-partitioned tables."""

import datetime as dt

from pyspark.sql import functions as F

from alertflow.operators import retention

NOW = dt.datetime(2024, 7, 1)


def table(spark, path):
    rows = []
    for age in (1, 20, 40, 41, 200, 201):
        at = NOW - dt.timedelta(days=age, hours=1)
        rows += [(f"closed-{age}", "s", "CLOSED", at), (f"open-{age}", "s", "OPEN", at)]
    rows.append(("closed-only", "s", "CLOSED", NOW - dt.timedelta(days=60, hours=1)))
    df = spark.createDataFrame(rows, "alert_id string, service_name string, status string, created_at timestamp_ntz")
    retention.write_days(df.withColumn("created_date", F.to_date("created_at")), path)
    return {r[0] for r in rows}


def left(spark, path):
    return {r.alert_id for r in spark.read.parquet(path).collect()}


def test_clean_days(spark, tmp_path):
    path = str(tmp_path / "t")
    every = table(spark, path)
    for _ in range(2):
        retention.clean_days(spark, path, F.lit(NOW), 30)
        assert left(spark, path) == {i for i in every if i.startswith("open") or i in ("closed-1", "closed-20")}
    days = {r.created_date for r in spark.read.parquet(path).select("created_date").distinct().collect()}
    assert (NOW - dt.timedelta(days=60, hours=1)).date() not in days


def test_archive_old_days(spark, tmp_path):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    every = table(spark, live)
    for _ in range(2):
        retention.archive_old_days(spark, live, archive, F.lit(NOW), 180)
        old = {i for i in every if i.endswith(("200", "201"))}
        assert left(spark, archive) == old and left(spark, live) == every - old

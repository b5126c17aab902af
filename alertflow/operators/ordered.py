"""Previous-row look-ups that stay parallel when one key holds a large part of the rows.

A plain ``lag`` over ``partitionBy(key)`` puts a hot key into one task. Here the
rows of a key are first split into time buckets; the window runs inside a
bucket, and the last value before a bucket comes from one pre-aggregated row
per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_bucket(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn(
        "_bucket",
        F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}) div {int(seconds)}"),
    )


def previous_values(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    last_known: Sequence[str] = (),
    bucket_s: int = 86_400,
) -> DataFrame:
    """Add ``previous_<c>`` for each column.

    ``columns`` take the row just before in (key, order); ``last_known`` take the
    latest earlier value that is not null. ``is_first`` marks a key's first row.
    """
    out = with_bucket(df, order[0], bucket_s)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)

    per_bucket = out.groupBy(key, "_bucket").agg(
        F.max_by(F.struct(*columns), at).alias("_end"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_known_{c}") for c in last_known],
    )
    across = Window.partitionBy(key).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        key,
        "_bucket",
        F.lag("_end").over(across).alias("_carry"),
        *[F.last(f"_known_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in last_known],
    )
    out = out.withColumns(
        {
            "_prev": F.lag(F.struct(*columns)).over(inside),
            **{f"_known_{c}": F.last(c, ignorenulls=True).over(so_far) for c in last_known},
        }
    ).join(carried, [key, "_bucket"])
    prev = F.coalesce("_prev", "_carry")
    return out.select(
        *df.columns,
        prev.isNull().alias("is_first"),
        *[prev[c].alias(f"previous_{c}") for c in columns],
        *[F.coalesce(f"_known_{c}", f"_carry_{c}").alias(f"previous_{c}") for c in last_known],
    )

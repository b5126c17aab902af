"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that Python code takes from an Arrow batch at a time.
SLICE = 256
#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; an own one only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is not None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="alertflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    ``by`` names a column of few values that gets a folder per value, so that a filter on it reads only those.

    The shuffle files of the write go when it ends, instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place of each row in ``order``, from 0, as ``name``; rows equal in ``order`` get some order among them.

    Ranges are sorted side by side and written; what comes before a range is a sum of one count per range.
    """
    at = F.monotonically_increasing_id()
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range of the shuffle, whatever the table holds
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return rows.withColumn(name, F.col("_base") + within).drop("_part", "_base", "_at")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts stay small, as JVM and Python each hold several of them at once outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter. Pure ASCII text takes the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def byte_rows(column: pa.Array) -> list[memoryview]:
    """UTF-8 bytes of each row of a string column, without decoding."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [x.as_buffer() if x.is_valid else b"" for x in column]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: ``node`` and ``root``, the smallest node it can reach, of every node with an edge.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each step hooks neighbours to the smallest of
    their group with an aggregate and a join, so a node with very many edges is combined before the shuffle and a
    skewed join is split; no group of neighbours is gathered. Every step is checkpointed.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = cut(edges.select(low.alias("u"), high.alias("v")).where(F.col("u") != F.col("v")).distinct())
    sums = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = edges.agg(*sums).first()
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least of the group
        large = edges.join(least, "u").select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()
        large = cut(large)
        # small star: neighbours below v, and v itself, go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v"))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
        now = edges.agg(*sums).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now

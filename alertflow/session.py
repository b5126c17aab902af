"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "alertflow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and the clock pinned to UTC.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration decides, and AQE coalesces or splits shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_folder(spark) -> str:
    """The folder the cluster names; one of its own only for a local session that names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        import tempfile

        folder = tempfile.mkdtemp(prefix="alertflow-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark, name: str) -> str:
    """A folder name below the checkpoint folder that nothing else uses."""
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, eager: bool = True):
    """Checkpoint ``df`` in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def stored(df, name: str):
    """Write ``df`` to the folder the cluster names and read it back: cuts the lineage like a checkpoint, packed.

    The shuffle files of the write go when it ends, instead of when the driver happens to collect its garbage.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = new_folder(spark, name), spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def once(df, name: str, value):
    """Add a costly column that is computed once per row.

    The optimizer copies an expression into every filter and projection that uses
    it. Behind a generator it is an ordinary attribute and is not copied.
    """
    from pyspark.sql import functions as F

    return df.select("*", F.explode(F.array(value)).alias(name))

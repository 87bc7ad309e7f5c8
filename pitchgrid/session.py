"""Session helpers: sessions for tests, checkpoints, input sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pitchgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is named, a fresh local one for a session on one machine (tests); a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("name a folder all executors share in spark.checkpoint.dir")
    return named or tempfile.mkdtemp(prefix="pitchgrid-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder; a folder is set only where the context has none."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df (file sizes for a plain scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions for a shuffle about the size of df: the session's number, more where df is known to be larger.

    Above 200,000, which a driver can still schedule, partitions grow; operators that use this stream
    sorted partitions and hold none."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return least if size >= 1 << 55 else max(least, min(200_000, -(-size // bytes_each)))  # 2^55: Spark's "unknown"


def spread(df: DataFrame, of: DataFrame) -> DataFrame:
    """df over all cores, for work in Python that costs far more than moving the rows. Inputs that their files already cut into
    as many pieces stay as they are. of: the scan df comes from; Spark takes a projection for smaller than the column it keeps."""
    spark = df.sparkSession
    each = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(of) < cores * each else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

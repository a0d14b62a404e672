"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets large top-n cuts (a day's budget) happen before the shuffle as well.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "corvane", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a local session gets a temporary one and any
    other fails: on a cluster the executors cannot see a folder of the driver's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="corvane-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt to all cores by `key` if it comes in fewer pieces, as a file of one row group does; what comes in
    many is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not replay (or re-sample) what came before."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: built once, read as often as wanted, and read
    again from there by whoever takes over from a lost executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "16g", app: str = "cohortry") -> SparkSession:
    """Session for tests and benchmarks; a cluster supplies its own."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; a temporary one only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    folder = named or tempfile.mkdtemp(prefix="cohortry-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def compiled(spark: SparkSession) -> SparkSession:
    """The session, where wide rows run in many small methods: the JVM never compiles a method of over 8,000 bytes, and one for a whole stage of a
    hundred columns is far larger."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: later plans neither recompute nor depend on executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`durable`, as a table by columns: for wide rows that later steps read again, a few columns at a time."""
    place = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)

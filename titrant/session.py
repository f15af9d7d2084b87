"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("titrant")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # call-site capture costs milliseconds per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(METHOD_LIMIT, COMPILED_BYTES)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def compiled_methods(spark: SparkSession) -> None:
    """Have Spark split generated methods that the JVM would never compile.

    The JVM interprets methods over 8,000 bytes, and the expressions of a row
    make longer ones.  A lower limit of the session's own stays."""
    if int(spark.conf.get(METHOD_LIMIT, "65535")) > int(COMPILED_BYTES):
        spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that `spark.checkpoint.dir`
    names.  Only a local master, whose executors share this machine's disk, may
    leave it unset; its folder goes when the program ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.TemporaryDirectory(prefix="titrant-", ignore_cleanup_errors=True)
            _own_folders.append(own)
            named = own.name
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_own_folders: list[tempfile.TemporaryDirectory] = []


def saved(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a stage as a table in the shared folder and read it back.

    Later stages start from the files: nothing upstream is recomputed when
    executors are lost or a stage is used twice, and the optimizer knows the
    true size when it chooses join strategies.  The files are packed more
    tightly than Spark's default does.
    """
    spark = df.sparkSession
    compiled_methods(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

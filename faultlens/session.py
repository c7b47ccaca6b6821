"""SparkSession set-up for local runs and tests.

On a cluster the session comes from the platform; ``ensure_checkpoint_dir``
only fills ``spark.checkpoint.dir`` when the cluster left it unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text injection and scoring are CPU-bound per row while their shuffles
    # are small in bytes: keep AQE from packing a small shuffle into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "faultlens") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    if "FAULTLENS_DRIVER_MEMORY" in os.environ:
        b = b.config("spark.driver.memory", os.environ["FAULTLENS_DRIVER_MEMORY"])
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master (tests, bench),
    where driver and executors are one process, gets a scratch folder when it is
    unset; anywhere else a machine-local folder would lose data, so it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="faultlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        delete_at_exit(spark, d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


JIT_BYTES = "8000"  # HotSpot never compiles a method of more bytes of code (HugeMethodLimit)


def compiled_code(spark: SparkSession) -> None:
    """Operators whose generated code HotSpot would only interpret run as separate, compiled
    projections instead: Spark's own limit lies at the 64 KB of the class format. A limit set
    by the session's owner is left alone."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_BYTES)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a scratch path when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)

"""Shared helpers: scratch tables in the cluster's folder, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import delete_at_exit


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a
    local master (tests) gets a folder of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def store(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: cuts
    lineage, and a lost executor re-reads the table instead of recomputing it."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**{k: str(v) for k, v in (options or {}).items()}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off_buf, data_buf = col.buffers()
    if not len(col) or off_buf is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off_buf, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges ``(a, b)`` of about ``limit`` bytes each; a longer row is one range."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, text)``: the key is the id and a hash of the text, so rows that
    share an id but not the text are decided apart."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose key (see ``with_key``) is in ``rejected(key)``."""
    gone = rejected.select(F.col("key.id").alias("gone_id"), F.col("key.hash").alias("gone_hash")).distinct()
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")

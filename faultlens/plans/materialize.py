"""Materialization points.

The episode bank and the reward log are built once and read by every
downstream analytic (scoring, gating, replay, audits). They are written as
Parquet tables into the cluster's shared ``spark.checkpoint.dir`` and read back:

* lost executors re-read the table instead of re-running injection;
* downstream scans get column pruning and predicate pushdown (an audit
  reading five columns does not touch the trace texts);
* downstream plans start from a plain scan, so filters the optimizer infers
  (join keys, ``explode`` inputs) are not pushed back through the staged
  injection projections, where alias substitution would re-expand every
  intermediate column into each predicate.

Every table written here is deleted when the driver's JVM ends. Shuffle files of a
write are dropped when it ends, not when the driver next collects garbage, and
tables are compressed with zstd: what lies on disk is the tables and one write's shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import compiled_code, delete_at_exit, ensure_checkpoint_dir

_KEPT: dict[tuple, DataFrame] = {}
_PASSING: list[list[str]] = []
PASSES = 8


def scratch_path(spark: SparkSession, name: str, passes: bool = True) -> str:
    """A new path in the shared folder, deleted at the end of the session."""
    compiled_code(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultlens-{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    if passes:
        for paths in _PASSING:
            paths.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within are deleted at its end: the paths in the list it gives."""
    paths: list[str] = []
    _PASSING.append(paths)
    try:
        yield paths
    finally:
        _PASSING.pop()
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs within go as each job ends."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old) if old else spark.conf.unset(CLEANUP)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Buckets of a stored table: two for each task of a shuffle."""
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def materialize_bucketed(df: DataFrame, name: str, by: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A stored copy in buckets of ``by``, one sorted file each: joins, windows and
    aggregates on ``by`` over it need no exchange. Rows are shuffled once, here, in
    ``PASSES`` passes that write a share of the buckets each, so that no more than this
    share of the shuffle is on disk; ``finish`` makes the stored rows of the
    shuffled ones, so that what it adds never crosses the network. ``df`` is read
    once a pass: a stored table, and cheap columns of it."""
    spark = df.sparkSession
    path, n = scratch_path(spark, name, passes=False), buckets(spark)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    bucket = F.pmod(F.hash(by), F.lit(n))  # the one that repartition and bucketBy choose
    with shuffles_dropped(spark):
        for at in range(PASSES):
            rows = df.where(F.pmod(bucket, F.lit(PASSES)) == at).repartition(n, by)
            rows = finish(rows) if finish else rows
            rows.write.mode("append" if at else "error").format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, by).sortBy(by).saveAsTable(table)
    return spark.table(table)


def share_of(by: str | Column, n: int = PASSES) -> Column:
    return F.pmod(F.hash(by), F.lit(n))


def materialize_shares(df: DataFrame, name: str, by: str | Column, finish: Callable[..., DataFrame], passes: bool = False, n: int = PASSES,
                       beside: DataFrame | None = None, bucket: str | None = None, **options: str) -> DataFrame:
    """A stored copy of ``finish(df)``, written in ``n`` passes over a share of the
    values of ``by`` each, so that no more than this share of what ``finish`` shuffles and
    stores is on disk. ``df`` is read once a pass: a stored table, and cheap columns of it.
    ``beside``: a second table, of which ``finish`` gets the same share. ``bucket``: rows lie
    in buckets of this column, by which ``finish`` has dealt them, a file a pass each.
    ``options``: of the Parquet writer, with ``_`` for dots."""
    spark = df.sparkSession
    path = scratch_path(spark, name, passes=passes)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    with shuffles_dropped(spark):
        for at in range(n):
            with passing(spark):
                rows = finish(*[x.where(share_of(by, n) == at) for x in (df, beside) if x is not None])
                writer = rows.write.mode("append" if at else "error").option("compression", "zstd").options(**{k.replace("_", "."): v for k, v in options.items()})
                if bucket:
                    writer.format("parquet").option("path", path).bucketBy(buckets(spark), bucket).saveAsTable(table)
                else:
                    writer.parquet(path)
    return spark.table(table) if bucket else spark.read.schema(rows.schema).parquet(path)


def kept(spark: SparkSession, name: str, key: tuple, make: Callable[[], DataFrame], by: str | None = None,
         finish: Callable[[DataFrame], DataFrame] | None = None, stored: bool = False) -> DataFrame:
    """One materialized copy of ``make()`` per session and key (its inputs and
    parameters), in buckets of ``by`` if named (see ``materialize_bucketed``), or as
    ``make`` stored it (``stored``). A new session starts with none."""
    session = spark._jsparkSession.sessionUUID()
    for k in [k for k in _KEPT if k[0] != session]:
        del _KEPT[k]
    k = (session, name, *key)
    if k not in _KEPT:
        if by or stored:
            with passing(spark):
                _KEPT[k] = materialize_bucketed(make(), name, by, finish) if by else make()
        else:
            _KEPT[k] = materialize(make(), name)
    return _KEPT[k]

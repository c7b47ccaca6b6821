"""Curves over a reward log that grows: what was computed is stored, and an append reads
only the appended rows and the last rows of each run.

A store keeps, as Parquet, each append in a folder of its own:

* ``rows``: the log, in folders by bucket of steps, ``(step - 1) div B``;
* ``sums``: per run and bucket the count and the sums in units of 1e-12;
* ``frames``: per row the sums over the last ``w`` rows, for each stored width. A trailing
  window looks back only, so a stored frame never changes;
* ``state``: per run its length and its curriculum switches, and its last rows.

Means over segments of a run add the sums of the buckets inside and read rows of the two
buckets at its ends. All sums are exact, so every result equals that of ``curves`` over the
whole log, bit for bit, however the log was cut into appends. An append counts once its
state is written: one that fails before leaves the store as it was, and is made again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.operators import curves as W
from faultlens.operators.audit import UNIT, units

_SUM = "decimal(38,0)"


class CurveStore:
    """``append`` takes ``(run_id, step, <cols>)``, run ids of ``run_type``, whose steps go on where each run ends;
    a gap or a repeat fails the append. A NULL run is a run like any other."""

    def __init__(self, spark: SparkSession, path: str, cols: Sequence[str] = ("r_total",), widths: Sequence[int] = (30, 50, 100),
                 bucket: int = W.DEFAULT_BUCKET, run_type: str = "long", level_col: str = "r_total", level_width: int = 100,
                 thresholds: Sequence[float] = (K.CURRICULUM_THRESHOLDS[1], K.CURRICULUM_THRESHOLDS[2])):
        if bucket < max(widths) or level_width not in widths or level_col not in cols:
            raise ValueError("a bucket must hold the widest window, and the curriculum's width and column must be stored")
        self.spark, self.path, self.cols, self.widths, self.bucket = spark, path.rstrip("/"), list(cols), sorted(widths), bucket
        self.run_type, self.level_col, self.level_width = run_type, level_col, level_width
        self.limits = [int(round(t * UNIT)) * level_width for t in thresholds]

    # -- what is stored ----------------------------------------------------

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last append, from 0; -1 for none."""
        at, fs = self._folder("state")
        if not fs.exists(at):
            return -1
        found = [f.getPath() for f in fs.listStatus(at)]
        whole = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "runs/_SUCCESS"))]
        return max((int(p.getName()) for p in whole), default=-1)

    def _stored(self, kind: str, schema: str, upto: int | None = None) -> DataFrame:
        done = self.last() if upto is None else upto
        if done < 0:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{kind}").where(F.col("batch") <= done)

    def _row_schema(self) -> str:
        return f"run_id {self.run_type}, step long, " + ", ".join(f"{c} double" for c in self.cols)

    def rows(self) -> DataFrame:
        return self._stored("rows", f"{self._row_schema()}, bucket long")

    def sums(self) -> DataFrame:
        return self._stored("sums", f"run_id {self.run_type}, bucket long, n long, " + ", ".join(f"{c} {_SUM}" for c in self.cols))

    def frames(self, w: int) -> DataFrame:
        if w not in self.widths:
            raise ValueError(f"width {w} is not stored")
        sums = ", ".join(f"{c}_wsum {_SUM}" for c in self.cols)
        return self._stored(f"frames/w{w}", f"run_id {self.run_type}, step long, _wcnt long, {sums}")

    def _state(self, kind: str, schema: str, done: int) -> DataFrame:
        if done < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/state/{done}/{kind}")

    def runs(self, done: int | None = None) -> DataFrame:
        """``(run_id, n, k1, k2)``: length, and the steps after which a run is on level 2 and 3."""
        return self._state("runs", f"run_id {self.run_type}, n long, k1 long, k2 long", self.last() if done is None else done)

    def tail(self, done: int | None = None) -> DataFrame:
        """The last rows of each run, one fewer than the widest window."""
        return self._state("tail", self._row_schema(), self.last() if done is None else done)

    # -- appending ---------------------------------------------------------

    def append(self, log: DataFrame) -> int:
        """Take further rows; returns the append's number."""
        done = self.last()
        i = done + 1
        bucket = F.floor((F.col("step") - 1) / F.lit(self.bucket)).cast("bigint")
        given = log.select(F.col("run_id").cast(self.run_type), F.col("step").cast("bigint"), *[F.col(c).cast("double") for c in self.cols])
        placed = given.withColumn("bucket", bucket).repartition("run_id", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={i}")
        new = self.spark.read.schema(f"{self._row_schema()}, bucket long").parquet(f"{self.path}/rows/batch={i}")

        runs, tail = self.runs(done), self.tail(done)
        came = new.groupBy("run_id").agg(F.count(F.lit(1)).alias("came"), F.min("step").alias("lo"), F.max("step").alias("hi"))
        came = W.by_run(came, runs.select("run_id", "n"), "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
        follows = (F.col("lo") == F.col("n") + 1) & (F.col("hi") == F.col("n") + F.col("came"))
        if not came.where(~F.coalesce(follows, F.lit(False))).isEmpty():
            raise ValueError("the steps of a run do not go on where it ended")

        sums = new.groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(units(F.col(c)).cast(_SUM)).cast(_SUM).alias(c) for c in self.cols])
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch={i}")

        own = new.drop("bucket").withColumn("_new", F.lit(True))
        seen = own.unionByName(tail.withColumn("_new", F.lit(False)))
        for w in self.widths:
            frames = W.halo_frames(seen, w, self.cols, self.bucket, own=F.col("_new"))
            stored = frames.select("run_id", "step", "_wcnt", *[F.col(f"{c}_wsum").cast(_SUM) for c in self.cols])
            stored.write.mode("overwrite").parquet(f"{self.path}/frames/w{w}/batch={i}")

        w, s = self.level_width, F.col(f"{self.level_col}_wsum")
        read = self.spark.read.parquet(f"{self.path}/frames/w{w}/batch={i}").where(F.col("step") >= w)
        k1 = read.where(s > self.limits[0]).groupBy("run_id").agg(F.min("step").alias("_k1"))
        state = W.by_run(came.select("run_id", "n", "came"), runs.select("run_id", "k1", "k2"), "run_id", "left")
        state = W.by_run(state, k1, "run_id", "left").withColumn("k1", F.coalesce("k1", "_k1")).drop("_k1")
        later = W.by_run(read.where(s > self.limits[1]), state.select("run_id", "k1"), "run_id").where(F.col("step") > F.col("k1"))
        k2 = later.groupBy("run_id").agg(F.min("step").alias("_k2"))
        state = W.by_run(state, k2, "run_id", "left").withColumn("k2", F.coalesce("k2", "_k2"))
        state = state.select("run_id", (F.col("n") + F.col("came")).alias("n"), "k1", "k2")
        still = W.by_run(runs, came.select("run_id", "came"), "run_id", "left").where("came IS NULL").drop("came")
        state = state.unionByName(still)

        ends = W.by_run(seen.drop("_new"), state.select("run_id", "n"), "run_id")
        ends = ends.where(F.col("step") > F.col("n") - (max(self.widths) - 1)).drop("n")
        ends.write.mode("overwrite").parquet(f"{self.path}/state/{i}/tail")
        state.write.mode("overwrite").parquet(f"{self.path}/state/{i}/runs")
        old, fs = self._folder(f"state/{i - 2}")
        if i > 1 and fs.exists(old):
            fs.delete(old, True)
        return i

    # -- results -----------------------------------------------------------

    def trailing_mean(self, w: int, col: str = "r_total", min_rows: int | None = None) -> DataFrame:
        """W1, as ``curves.trailing_mean``."""
        mean = F.col(f"{col}_wsum").cast("double") / F.col("_wcnt").cast("double") / F.lit(float(UNIT))
        shown = F.when(F.col("step") >= (w if min_rows is None else min_rows), mean)
        return self.frames(w).select("run_id", "step", shown.alias("trailing_mean"))

    def rolling_curve(self, cols: Sequence[str] = ("r_total",), policy: str = "c") -> DataFrame:
        """W2/W3, as ``curves.rolling_curve``. A run long enough for the policy's widest
        window reads stored frames; a shorter one, a few hundred rows, is computed again."""
        most = W.POLICY_MAX[policy]
        sized = self.runs().withColumn("w", W.policy_width(F.col("n"), policy))
        long = W.by_run(self.frames(most).where(F.col("step") >= most), sized.where(F.col("w") == most).select("run_id", "w"), "run_id")
        sel = [(F.col(f"{c}_wsum").cast("double") / F.col("w").cast("double") / F.lit(float(UNIT))).alias(f"roll_{c}") for c in cols]
        long = long.select("run_id", "step", F.col("w").cast("int").alias("w"), *sel)
        short = self.rows().where(F.col("bucket") <= (5 * most) // self.bucket)
        short = W.by_run(short, sized.where(F.col("w") < most).select("run_id", "w"), "run_id").select("run_id", "step", *cols)
        return long.unionByName(W.rolling_curve(short, cols, policy, self.bucket))

    def curriculum(self) -> DataFrame:
        """W5, as ``curves.curriculum`` checked at every reward."""
        on = lambda k: F.coalesce((F.col("step") > F.col(k)).cast("int"), F.lit(0))
        led = W.by_run(self.rows().select("run_id", "step"), self.runs(), "run_id")
        return led.select("run_id", "step", (F.lit(1) + on("k1") + on("k2")).cast("int").alias("curriculum_level"))

    def segment_sums(self, segments: DataFrame, cols: Sequence[str]) -> DataFrame:
        """``segments(run_id, name, lo, hi)`` -> for each the count ``rows`` of its steps in
        (lo, hi] and the sums of ``cols`` in units; whole buckets from their sums, rows only
        from buckets that a segment's ends cut."""
        b, size = F.col("bucket"), F.lit(self.bucket)
        held = lambda c: F.sum(c).cast(_SUM).alias(c)
        stored = W.by_run(self.sums().drop("batch"), segments, "run_id")
        inside = stored.where((b * size >= F.col("lo")) & ((b + 1) * size <= F.col("hi")))
        parts = inside.select("run_id", "name", F.col("n").alias("rows"), *cols)
        first, final = F.floor(F.col("lo") / size).cast("bigint"), F.floor((F.col("hi") - 1) / size).cast("bigint")
        cut = segments.where(F.col("hi") > F.col("lo")).withColumn("_bucket", F.explode(F.array_distinct(F.array(first, final))))
        cut = cut.where((F.col("_bucket") * size < F.col("lo")) | ((F.col("_bucket") + 1) * size > F.col("hi"))).withColumnRenamed("run_id", "_run")
        rows = self.rows().join(cut, (F.col("bucket") == F.col("_bucket")) & F.col("run_id").eqNullSafe(F.col("_run")))
        rows = rows.where((F.col("step") > F.col("lo")) & (F.col("step") <= F.col("hi")))
        parts = parts.unionByName(rows.select("run_id", "name", F.lit(1).cast("bigint").alias("rows"), *[units(F.col(c)).cast(_SUM).alias(c) for c in cols]))
        return parts.groupBy("run_id", "name").agg(F.sum("rows").alias("rows"), *[held(c) for c in cols])

    def early_late(self, policy: str = "floor_ceil", col: str = "r_total", hit_col: str = "correct") -> DataFrame:
        """W8/W8b/W9, as ``curves.early_late``; ``hit_col`` is 1 where the step was located, else 0."""
        n = F.col("n")
        floor5, ceil5 = F.floor(n / 5), F.floor((n + 4) / 5)
        if policy not in ("floor_ceil", "floor_floor"):
            raise ValueError(policy)
        least = F.greatest(floor5, F.lit(1))
        early, late = (floor5, ceil5) if policy == "floor_ceil" else (least, least)

        def segment(name: str, lo: Column, hi: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))

        zero = F.lit(0)
        wanted = F.array(segment("early", zero, early), segment("late", n - late, n), segment("hit_early", zero, floor5), segment("hit_late", n - ceil5, n))
        found = self.segment_sums(self.runs().select("run_id", F.inline(wanted)), [col, hit_col])
        of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
        mean = lambda name: of(name, col).cast("double") / of(name, "rows").cast("double") / F.lit(float(UNIT))
        hits = lambda name: F.coalesce(of(name, hit_col), F.lit(0)).cast("double") / F.lit(float(UNIT))
        share = lambda name: hits(name) / F.greatest(F.coalesce(of(name, "rows"), F.lit(0)), F.lit(1)).cast("double")
        out = found.groupBy("run_id").agg(
            mean("early").alias("early_mean"), mean("late").alias("late_mean"), share("hit_early").alias("early_accuracy"), share("hit_late").alias("late_accuracy")
        )
        out = W.by_run(self.runs().select("run_id", "n"), out, "run_id")
        return out.select("run_id", "n", "early_mean", "late_mean", (F.col("late_mean") - F.col("early_mean")).alias("improvement"), "early_accuracy", "late_accuracy")

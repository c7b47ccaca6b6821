"""Windows and sequence analytics over reward logs.

A reward log has ``run_id, step`` (1..n, dense per run) and reward columns.
Every operator is partitioned by run, and the two places where a single
run would otherwise become one task are split:

* trailing windows use *halo buckets*: rows are bucketed by
  ``(step - 1) div B`` and the last ``w - 1`` rows of each bucket are copied
  into the next one as non-owned rows, so the window runs per
  ``(run, bucket)`` and a huge run spreads over many tasks;
* segment means (first/last fifth, tail means) are conditional partial
  aggregates per run, which combine map-side.

Sums are over integer units of 1e-12, so means and threshold tests are exact
and order-independent. A NULL run id is a run like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.operators.audit import UNIT, unit_mean, units

DEFAULT_BUCKET = 1 << 20


def run_sizes(log: DataFrame, run_col: str = "run_id") -> DataFrame:
    return log.groupBy(run_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def by_run(left: DataFrame, right: DataFrame, run_col: str, how: str = "inner") -> DataFrame:
    """Join per-run values to rows of a log; a NULL run is a run like any other."""
    right = right.withColumnRenamed(run_col, "_run")
    return left.join(right, F.col(run_col).eqNullSafe(F.col("_run")), how).drop("_run")


def with_run_size(log: DataFrame, run_col: str = "run_id") -> DataFrame:
    return by_run(log, run_sizes(log, run_col), run_col)


def _or_fail(dense: Column) -> Column:
    return F.when(dense, F.lit(True)).otherwise(F.raise_error(F.lit("steps of a run are not 1..n")).cast("boolean"))


def halo_frames(log: DataFrame, w: int, cols: Sequence[str], bucket: int = DEFAULT_BUCKET,
                run_col: str = "run_id", own: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Trailing-``w`` frame per row via halo buckets.

    Returns ``run_col, step`` plus for each value column ``c``:
    ``{c}_wsum`` (sum in units over the last ``w`` rows incl. this one) and
    ``_wcnt`` (rows in that frame). Steps must be 1..n in every run (number them
    with ``plans.dense.dense_index`` otherwise): a gap or a repeat fails the job.

    ``own``: rows for which it does not hold are only context, at least the ``w`` - 1
    rows before a run's first own one; so a piece of a log can be framed. ``keep``:
    further columns to return.
    """
    if bucket < w:
        raise ValueError("a bucket must hold at least one window")
    base = log.select(run_col, "step", *keep, (F.lit(True) if own is None else own).alias("_owned"), *[units(F.col(c)).alias(c) for c in cols])
    b = F.floor((F.col("step") - 1) / F.lit(bucket)).cast("bigint")
    owned = base.withColumn("_bucket", b)
    pos = F.pmod(F.col("step") - 1, F.lit(bucket))
    halo = (
        base.where(pos >= bucket - (w - 1))
        .withColumn("_bucket", b + 1)
        .withColumn("_owned", F.lit(False))
    )
    rows = owned.unionByName(halo) if w > 1 else owned
    win = Window.partitionBy(run_col, "_bucket").orderBy("step").rowsBetween(-(w - 1), 0)
    count = F.count(F.lit(1)).over(win)
    wanted = F.least(F.col("step"), F.lit(w).cast("bigint"))
    dense = (count == wanted) & (F.col("step") - F.min("step").over(win) == wanted - 1)
    sel = [run_col, "step", *keep, "_owned", count.alias("_wcnt"), dense.alias("_dense")]
    for c in cols:
        sel.append(F.sum(c).over(win).alias(f"{c}_wsum"))
    return rows.select(*sel).where("_owned").where(_or_fail(F.col("_dense"))).drop("_owned", "_dense")


def trailing_mean(log: DataFrame, w: int, col: str = "r_total", min_rows: int | None = None,
                  bucket: int = DEFAULT_BUCKET, run_col: str = "run_id") -> DataFrame:
    """Mean of the last ``w`` rewards at each step, only once at least
    ``min_rows`` (default ``w``) rewards exist."""
    min_rows = w if min_rows is None else min_rows
    f = halo_frames(log, w, [col], bucket, run_col)
    mean = F.col(f"{col}_wsum").cast("double") / F.col("_wcnt").cast("double") / F.lit(float(UNIT))
    return f.select(run_col, "step", F.when(F.col("step") >= min_rows, mean).alias("trailing_mean"))


#: Widest rolling window of any policy.
POLICY_MAX = {"a": 50, "b": 50, "c": 50, "interim": 30}


def policy_width(n: Column, policy: str) -> Column:
    """Rolling width per run from its length ``n`` (NULL: no curve).

    a: n > 10 -> min(50, n//5); b: n > 20 -> min(50, n//5), else 5 when
    n > 5; c: n > 20 -> min(50, n//5); interim: n > 10 -> min(30, n//3).
    """
    most = F.lit(POLICY_MAX[policy])
    d5 = F.least(most, F.floor(n / 5).cast("bigint"))
    if policy == "a":
        w = F.when(n > 10, d5)
    elif policy == "b":
        w = F.when(n > 20, d5).when(n > 5, F.lit(5))
    elif policy == "c":
        w = F.when(n > 20, d5)
    elif policy == "interim":
        w = F.when(n > 10, F.least(most, F.floor(n / 3).cast("bigint")))
    return F.when(w > 1, w)


def rolling_curve(log: DataFrame, cols: Sequence[str] = ("r_total",), policy: str = "c",
                  bucket: int = DEFAULT_BUCKET, run_col: str = "run_id") -> DataFrame:
    """W2/W3: "valid" rolling means with a per-run width ``w`` from the
    policy: one row per step ``k >= w`` holding the mean of rows k-w+1..k.

    A value enters the sum at its step and leaves it ``w`` steps later, so the
    rolling sum is one running sum over both events, whatever the run's width.
    Events are dealt to halo buckets as in ``halo_frames``. Steps must be 1..n
    in every run: a gap or a repeat fails the job."""
    most = POLICY_MAX[policy]
    if bucket < most:
        raise ValueError("a bucket must hold at least one window")
    sizes = run_sizes(log, run_col).withColumn("w", policy_width(F.col("n"), policy)).where(F.col("w").isNotNull())
    d = by_run(log.select(run_col, "step", *[units(F.col(c)).alias(c) for c in cols]), sizes, run_col)
    step, w = F.col("step"), F.col("w")
    own = F.floor((step - 1) / F.lit(bucket)).cast("bigint")
    gone = F.floor((step + w - 1) / F.lit(bucket)).cast("bigint")

    def event(b, at, sign, owned):
        values = [(F.lit(sign).cast("bigint") * F.col(c)).alias(c) for c in cols]
        return F.struct(b.alias("_bucket"), at.alias("step"), F.lit(owned).alias("_owned"), F.lit(sign).alias("_one"), *values)

    near_end = F.pmod(step - 1, F.lit(bucket)) >= F.lit(bucket) - (w - 1)
    events = F.array(
        event(own, step, 1, True),
        F.when(near_end, event(own + 1, step, 1, False)),
        # it leaves the bucket it had entered; what never came in does not leave
        F.when(step + w > gone * bucket + 1, event(gone, step + w, -1, False)),
    )
    rows = d.select(run_col, "w", F.inline(F.array_compact(events)))
    win = Window.partitionBy(run_col, "_bucket").orderBy("step", "_owned").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select(
        run_col, "step", "w", "_owned", F.sum("_one").over(win).alias("_in"), *[F.sum(c).over(win).alias(c) for c in cols]
    ).where("_owned").where(_or_fail(F.col("_in") == F.least(step, w)))
    sel = [(F.col(c).cast("double") / w.cast("double") / F.lit(float(UNIT))).alias(f"roll_{c}") for c in cols]
    return sums.where(step >= w).select(run_col, "step", w.cast("int").alias("w"), *sel)


def rolling_accuracy(log: DataFrame, policy: str = "c", bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Rolling share of exact localizations, next to the 1/3 chance line."""
    acc = log.select("run_id", "step", F.when(F.col("predicted_step") == F.col("true_step"), 1.0)
                     .otherwise(0.0).alias("correct"))
    return rolling_curve(acc, ["correct"], policy, bucket).withColumn("chance", F.lit(1.0) / F.lit(3.0))


def curriculum(log: DataFrame, w: int = 100, check_every: int = 1, col: str = "r_total",
               thresholds=(K.CURRICULUM_THRESHOLDS[1], K.CURRICULUM_THRESHOLDS[2]),
               bucket: int = DEFAULT_BUCKET, run_col: str = "run_id") -> DataFrame:
    """Curriculum level per log row.

    k1 = first valid k >= w whose trailing-w mean is strictly above the
    first threshold, k2 = first valid k > k1 above the second; rows up to
    k1 are level 1, up to k2 level 2, later level 3. Valid k: every
    ``check_every``-th reward (1 = every reward, as the environment checks).
    The threshold test is exact: ``sum_units > t * UNIT * w``.
    """
    t1 = int(round(thresholds[0] * UNIT)) * w
    t2 = int(round(thresholds[1] * UNIT)) * w
    f = halo_frames(log, w, [col], bucket, run_col)
    cand = f.where((F.col("step") >= w) & (F.pmod(F.col("step"), F.lit(check_every)) == 0))
    s = F.col(f"{col}_wsum")
    k1 = cand.where(s > t1).groupBy(run_col).agg(F.min("step").alias("k1"))
    k2 = by_run(cand, k1, run_col).where((F.col("step") > F.col("k1")) & (s > t2)).groupBy(run_col).agg(
        F.min("step").alias("k2")
    )
    ks = by_run(k1, k2, run_col, "left")
    out = by_run(log.select(run_col, "step"), ks, run_col, "left")
    lvl = (
        F.when(F.col("k1").isNull() | (F.col("step") <= F.col("k1")), F.lit(1))
        .when(F.col("k2").isNull() | (F.col("step") <= F.col("k2")), F.lit(2))
        .otherwise(F.lit(3))
    )
    return out.select(run_col, "step", lvl.alias("curriculum_level"))


def final_mean(log: DataFrame, tail: int = 50, col: str = "r_total") -> DataFrame:
    """``sum(last tail) / min(n, tail)`` per run."""
    d = with_run_size(log).where(F.col("step") > F.col("n") - tail)
    return d.groupBy("run_id").agg(unit_mean(F.col(col)).alias("final_mean"))


def best_mean(log: DataFrame, w: int = 50, include_last: bool = False, col: str = "r_total",
              bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Best window mean, always divided by ``w``; as in the original the
    window ending at the last row is skipped unless ``include_last`` (and a
    run shorter than ``w`` yields its sum / w)."""
    f = by_run(halo_frames(log, w, [col], bucket), run_sizes(log), "run_id")
    lo = F.least(F.lit(w), F.col("n"))
    hi = F.col("n") if include_last else F.greatest(lo, F.col("n") - 1)
    f = f.where((F.col("step") >= lo) & (F.col("step") <= hi))
    return f.groupBy("run_id").agg(
        (F.max(f"{col}_wsum").cast("double") / F.lit(float(w)) / F.lit(float(UNIT))).alias("best_mean")
    )


def _seg_mean(cond: Column, val: Column) -> Column:
    return F.sum(F.when(cond, val)).cast("double") / F.count(F.when(cond, F.lit(1))).cast("double")


def early_late(log: DataFrame, policy: str = "floor_ceil", col: str = "r_total") -> DataFrame:
    """Mean reward of the first and last fifth, improvement, and
    localization accuracy in the same segments.

    floor_ceil: early = first n//5 rows, late = last ceil(n/5) (NULL means
    when a side is empty); floor_floor: both max(n//5, 1), accuracy still
    over the last ceil(n/5). Accuracy is 0 for an empty side."""
    d = with_run_size(log)
    n, s = F.col("n"), F.col("step")
    ceil5 = F.floor((n + 4) / 5)
    if policy == "floor_ceil":
        k_early, k_late = F.floor(n / 5), ceil5
    elif policy == "floor_floor":
        k_early = k_late = F.greatest(F.floor(n / 5), F.lit(1))
    else:
        raise ValueError(policy)
    early, late = s <= k_early, s > n - k_late
    acc_early, acc_late = s <= F.floor(n / 5), s > n - ceil5
    v = units(F.col(col)).cast("decimal(38,0)")
    hit = F.when(F.col("predicted_step") == F.col("true_step"), 1).otherwise(0)
    g = d.groupBy("run_id").agg(
        F.first("n").alias("n"),
        (_seg_mean(early, v) / F.lit(float(UNIT))).alias("early_mean"),
        (_seg_mean(late, v) / F.lit(float(UNIT))).alias("late_mean"),
        F.sum(F.when(acc_early, hit)).alias("_he"), F.count(F.when(acc_early, 1)).alias("_ne"),
        F.sum(F.when(acc_late, hit)).alias("_hl"), F.count(F.when(acc_late, 1)).alias("_nl"),
    )
    acc = lambda h, c: F.coalesce(F.col(h), F.lit(0)).cast("double") / F.greatest(F.col(c), F.lit(1)).cast("double")
    return g.select(
        "run_id", "n", "early_mean", "late_mean", (F.col("late_mean") - F.col("early_mean")).alias("improvement"),
        acc("_he", "_ne").alias("early_accuracy"), acc("_hl", "_nl").alias("late_accuracy"),
    )


def early_late_by_level(log: DataFrame, col: str = "r_total", min_rows: int = 10) -> DataFrame:
    """First vs last ``max(n//5, 10)`` rows, mean reward per level with
    levels 1-3 always present (0 when a level has no rows there)."""
    d = with_run_size(log)
    n5 = F.greatest(F.floor(F.col("n") / 5), F.lit(min_rows))
    d = d.withColumn("_first", F.col("step") <= n5).withColumn("_last", F.col("step") > F.col("n") - n5)
    v = units(F.col(col)).cast("decimal(38,0)")
    g = d.groupBy("run_id", "level").agg(
        F.sum(F.when(F.col("_first"), v)).alias("_sf"), F.count(F.when(F.col("_first"), 1)).alias("_cf"),
        F.sum(F.when(F.col("_last"), v)).alias("_sl"), F.count(F.when(F.col("_last"), 1)).alias("_cl"),
    )
    spine = run_sizes(log).select("run_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("level"))
    g = g.withColumnRenamed("run_id", "_run").withColumnRenamed("level", "_level")
    j = spine.join(g, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("level") == F.col("_level")), "left")

    def mean(sc, cc):
        return F.when(F.coalesce(F.col(cc), F.lit(0)) > 0,
                      F.col(sc).cast("double") / F.col(cc).cast("double") / F.lit(float(UNIT))).otherwise(F.lit(0.0))

    return j.select("run_id", F.col("level").cast("int").alias("level"),
                    mean("_sf", "_cf").alias("first_mean"), mean("_sl", "_cl").alias("last_mean"))

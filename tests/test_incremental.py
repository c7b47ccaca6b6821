"""Curves over appended logs equal those over the whole log."""

import pytest
from pyspark.sql import functions as F

from faultlens.operators import curves as W
from faultlens.operators.incremental import CurveStore

COLS = ["r_total", "correct"]


def log_of(spark, sizes):
    """Runs of the given sizes; rewards rise, so that levels switch; some are NULL."""
    parts = [spark.range(1, n + 1).select(F.lit(r).cast("long").alias("run_id"), F.col("id").alias("step")) for r, n in sizes.items()]
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    noise = F.pmod(F.hash("run_id", "step"), F.lit(1000)) / 1000
    r = F.round(F.least(F.lit(1.0), F.col("step") / 700 * (0.6 + noise)), 4)
    hit = F.pmod(F.hash("step"), F.lit(3))
    return log.select("run_id", "step", F.when(F.pmod("step", F.lit(37)) != 5, r).alias("r_total"), hit.alias("predicted_step"),
                      F.lit(1).alias("true_step"), F.when(hit == 1, 1.0).otherwise(0.0).alias("correct"))


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    log = log_of(spark, {1: 1400, 2: 3, 3: 260, None: 700, 4: 40}).cache()
    store = CurveStore(spark, str(tmp_path_factory.mktemp("curves")), COLS, bucket=128)
    store.append(log.where("run_id = 1 AND step <= 130 OR run_id IS NULL AND step <= 699 OR run_id = 3 AND step <= 120"))
    store.append(log.where("run_id = 1 AND step BETWEEN 131 AND 1386 OR run_id IN (2, 4)"))
    store.append(log.where("run_id = 1 AND step > 1386 OR run_id IS NULL AND step > 699 OR run_id = 3 AND step > 120"))
    return log, store


def test_trailing_means_and_levels(grown):
    log, store = grown
    for w in (30, 50, 100):
        assert rows_of(store.trailing_mean(w)) == rows_of(W.trailing_mean(log, w, bucket=128))
    levels = store.curriculum()
    assert rows_of(levels) == rows_of(W.curriculum(log, bucket=128))
    assert levels.select("curriculum_level").distinct().count() == 3


@pytest.mark.parametrize("policy", ["a", "b", "c", "interim"])
def test_rolling_curves(grown, policy):
    log, store = grown
    assert rows_of(store.rolling_curve(COLS, policy)) == rows_of(W.rolling_curve(log, COLS, policy, 128))


@pytest.mark.parametrize("policy", ["floor_ceil", "floor_floor"])
def test_early_and_late(grown, policy):
    log, store = grown
    assert rows_of(store.early_late(policy)) == rows_of(W.early_late(log, policy))


def test_only_cut_buckets_are_read(grown, spark):
    """A segment of eight whole buckets and two cut ones reads two; pruning is by folder."""
    _, store = grown
    segment = spark.createDataFrame([(1, "s", 100, 1300)], "run_id long, name string, lo long, hi long")
    got = store.segment_sums(segment, ["correct"])
    assert [r.rows for r in got.collect()] == [1200]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_an_append_reads_no_stored_rows(spark, tmp_path):
    """Rows and frames of earlier appends are gone, and the next append is right still."""
    log = log_of(spark, {1: 900})
    store = CurveStore(spark, str(tmp_path / "s"), COLS, bucket=128)
    store.append(log.where("step <= 890"))
    for kind in ("rows", "sums", "frames/w30", "frames/w50", "frames/w100"):
        at, fs = store._folder(f"{kind}/batch=0")
        fs.delete(at, True)
    store.append(log.where("step > 890"))
    want = W.trailing_mean(log, 100, bucket=128).where("step > 890")
    assert rows_of(store.trailing_mean(100)) == rows_of(want)
    assert store.tail().count() == 99 and [r.n for r in store.runs().collect()] == [900]


def test_gaps_repeats_and_nothing(spark, tmp_path):
    log = log_of(spark, {1: 20})
    store = CurveStore(spark, str(tmp_path / "s"), COLS, bucket=128)
    assert store.last() == -1 and store.rolling_curve().count() == 0 and store.early_late().count() == 0
    store.append(log.where("step <= 10"))
    for wrong in ("step > 11", "step > 9", "step IN (11, 13)"):
        with pytest.raises(ValueError):
            store.append(log.where(wrong))
    twice = log.where("step IN (11, 13)").unionByName(log.where("step = 11"))
    with pytest.raises(Exception, match="not 1..n"):
        store.append(twice)
    store.append(log.where("step < 0"))
    store.append(log.where("step > 10"))
    assert store.last() == 2
    assert rows_of(store.early_late()) == rows_of(W.early_late(log))

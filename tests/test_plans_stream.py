"""Properties, plan checks, streaming = batch, and the DuckDB oracle on a
subset of registered queries at sf0.001."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from faultlens.operators import curves as W
from faultlens.operators.traces import TRUTH_COLUMNS, observation_view
from faultlens.plans import bindings as B
from faultlens.plans import queries as Q
from faultlens.plans.dense import dense_index
from faultlens.streaming.stream import curriculum_stream, run_to_parquet


def drained(df):
    d = tempfile.mkdtemp(prefix="faultlens-stream-")
    return run_to_parquet(df, f"{d}/out", f"{d}/progress")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["level", "n", "mean_total", "mean_localization", "mean_blame", "mean_fix"]
    assert len(rows) == 3 and all(0.0 <= r.mean_total <= 1.0 for r in rows)


def test_bank_properties(spark):
    bank = B.lineitem_bank(spark, SF_SMALL)
    bad = bank.where(
        (F.size("expected_fix_keywords") < 1) | (F.size("expected_fix_keywords") > 5)
        | (F.size(F.filter(F.zip_with("clean_pipeline", "corrupted_pipeline", lambda a, b: a["output"] != b["output"]),
                           lambda x: x)) > 1)
    ).count()
    assert bad == 0
    obs = observation_view(bank)
    assert not set(TRUTH_COLUMNS) & set(obs.columns)


# `bank_of_tables` matches a bank of any size by automata in Arrow batches (see `operators/banks.py`)
@pytest.mark.parametrize("name", sorted(set(Q.REGISTRY) - {"bank_of_tables"}))
def test_no_python_and_no_cross_join_in_plans(spark, name):
    plan = Q.REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct"):
        assert word not in plan


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_few_scans_of_the_bank(spark):
    assert scans(Q.REGISTRY["audit_bank"](spark, SF_SMALL)) == 1
    assert scans(Q.REGISTRY["render_prompt"](spark, SF_SMALL)) == 1
    assert "Join" not in Q.REGISTRY["render_prompt"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_audit_equals_its_single_checks(spark):
    from faultlens.operators import audit as G

    bank = B.planted_bank(B.lineitem_bank(spark, SF_SMALL))
    got = {(r["check"], r["subject"]): r["value"] for r in G.audit_bank(bank).collect()}
    for r in G.step_uniformity(bank).collect():
        assert got["step_uniformity", f"plen={r.plen}"] == r.chi2
    for r in G.role_share(bank).collect():
        assert got["role_share", r.injected_role] == r.pct
    kw, same = G.keyword_quality(bank).first(), G.noop_corruptions(bank).first()
    assert got["keyword_quality", "empty"] == kw.empty_keywords > 0 and got["keyword_quality", "trivial"] == kw.trivial_keywords > 0
    assert got["noop_corruptions", "identical"] == same.identical


def test_every_source_line_is_a_step(spark):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    steps = B.lineitem_steps(lines)
    assert steps.count() == lines.count()
    assert steps.groupBy("trace_id").agg(F.max("step_id").alias("m"), F.count("*").alias("n"), F.max("n_steps").alias("s")).where(
        "m <> n or n <> s or n > 6").count() == 0
    hot = lines.withColumn("l_orderkey", F.lit(7))  # one order of all lines
    assert B.lineitem_steps(hot).select("trace_id", "step_id").distinct().count() == lines.count()


def test_submitted_totals_stay_below_the_gate_bonus(spark):
    from faultlens.operators.score import score_total

    bank = B.lineitem_bank(spark, SF_SMALL)
    perfect = bank.selectExpr("*", "injected_step as fault_step_id", "injected_role as blame_role", "original_output as fix_content")
    top = score_total(perfect, "server", turn=F.lit(1), accepted=F.lit(False)).agg(F.max("total"), F.max("precision")).first()
    assert 0.9 < top[0] <= 0.92 and top[1] == 0.2


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_sampling_does_not_depend_on_partitions(spark, parts):
    from faultlens.operators import sampling as X

    bank = B.lineitem_bank(spark, SF_SMALL)
    dealt = bank.repartition(parts)
    for f in (lambda b: X.sample_with_replacement(b, 2, 50), lambda b: X.sample_cyclic(b, 3, 50), lambda b: X.pick_kth(b, {1: 42, 9: 5}),
              lambda b: X.head_per_group(b, n=7), lambda b: X.sample_one(b)):
        ids = [sorted(r.pipeline_id for r in f(b).collect()) for b in (bank, dealt)]
        assert ids[0] == ids[1] and ids[0]


def test_empty_level_uses_the_whole_bank(spark):
    from faultlens.operators import sampling as X

    bank = B.lineitem_bank(spark, SF_SMALL)
    order = [r.pipeline_id for r in bank.orderBy("bank_pos").limit(9).select("pipeline_id").collect()]
    assert [r.pipeline_id for r in X.pick_kth(bank, {9: 5}).collect()] == [order[5]]
    assert sorted(r.pipeline_id for r in X.sample_cyclic(bank, 9, 9).collect()) == sorted(order)


def test_null_runs_are_runs(spark):
    log = spark.createDataFrame([(None, i, 1, 0.9) for i in range(1, 201)], "run_id long, step long, level int, r_total double")
    log = log.withColumns({"predicted_step": F.lit(1), "true_step": F.lit(1)})
    assert [r.curriculum_level for r in W.curriculum(log).orderBy("step").collect()] == [1] * 100 + [2] + [3] * 99
    assert W.final_mean(log).first().final_mean == pytest.approx(0.9) and W.early_late(log).first().late_mean == pytest.approx(0.9)
    assert W.rolling_curve(log).count() == 161 and W.best_mean(log).count() == 1
    assert {r.last_mean for r in W.early_late_by_level(log).collect()} == {0.0, 0.9}
    from faultlens.operators.audit import run_status

    assert run_status(log).first().recent_mean == pytest.approx(0.9)


@pytest.mark.parametrize("steps", [[1, 2, 4, 5] + list(range(6, 60)), [1, 1] + list(range(2, 60))])
def test_gaps_and_repeats_of_steps_fail(spark, steps):
    log = spark.createDataFrame([(1, s, 0.5) for s in steps], "run_id long, step long, r_total double")
    for f in (lambda: W.trailing_mean(log, 5), lambda: W.rolling_curve(log, bucket=64)):
        with pytest.raises(Exception, match="1..n"):
            f().collect()


@pytest.mark.parametrize("policy", ["a", "b", "c", "interim"])
def test_rolling_sums_across_buckets(spark, policy):
    log = B.events_reward_log(spark, SF_MID)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(W.rolling_curve(log, ["r_total", "r_fix"], policy, bucket=64)) == key(W.rolling_curve(log, ["r_total", "r_fix"], policy))


def test_swap_banks_of_any_size(spark):
    from faultlens.operators.inject import inject_column

    pairs = [(f"w{i} ", f"v{i} ") for i in range(150)]
    df = spark.createDataFrame([("wrong_type", f"a w{i} b", f"p{i}") for i in range(150)], "e string, t string, p string")
    got = inject_column(df, "e", "t", "p", "o", swaps={"wrong_type": pairs}).collect()
    assert all(r.o == r.t.replace("w", "v") for r in got)


def test_dense_index_keeps_null_groups_and_whole_tables(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("g"), "id")
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    got = dense_index(df, ["g"], ["id"], "idx", n_ranges=7)
    assert got.count() == 100 and got.join(ref, "id").where("idx <> ref").count() == 0
    assert dense_index(df, [], ["id"], "idx", n_ranges=7).where("idx <> id + 1").count() == 0


def test_dense_index_equals_row_number_on_hot_group(spark):
    # one group holds most rows
    df = spark.range(20000).withColumn("g", F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10)) \
        .withColumn("o", (F.col("id") * 7919) % 20000)
    d = dense_index(df, ["g"], ["o"], "idx", n_ranges=13)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert d.join(ref, ["id"]).where(F.col("idx") != F.col("ref")).count() == 0


def test_halo_window_equals_plain_window(spark):
    log = B.events_reward_log(spark, SF_MID)
    small = W.trailing_mean(log, 30, bucket=64)
    big = W.trailing_mean(log, 30)
    diff = small.join(big.withColumnRenamed("trailing_mean", "t2"), ["run_id", "step"]) \
        .where(~F.col("trailing_mean").eqNullSafe(F.col("t2")))
    assert diff.count() == 0 and small.count() == log.count()


@pytest.mark.parametrize("w,every", [(100, 1), (30, 20)])
def test_curriculum_stream_equals_batch(spark, w, every):
    log = B.events_reward_log(spark, SF_MID).select("run_id", "step", "r_total")
    src = tempfile.mkdtemp(prefix="faultlens-stream-src-")
    for lo in range(0, 2000, 500):  # four appends in step order: state must carry across micro-batches
        log.where((F.col("step") > lo) & (F.col("step") <= lo + 500)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = drained(curriculum_stream(stream, w=w, check_every=every, snapshot_every=50, group=4))
    assert out.where(F.col("snapshot") != ((F.col("step") >= 50) & (F.col("step") % 50 < 4))).count() == 0
    batch = W.curriculum(log, w=w, check_every=every)
    j = out.where(~F.col("late")).join(batch.withColumnRenamed("curriculum_level", "b"), ["run_id", "step"])
    assert j.count() == log.count()
    assert j.where(F.col("curriculum_level") != F.col("b")).count() == 0
    # every run leaves level 1 on this log (level-2 rows exist)
    assert j.where("b >= 2").select("run_id").distinct().count() == 8


ORACLE_SUBSET = ["bank_lineitem", "flagship", "gate", "parse_strict", "replay", "replay_all", "sample_cyclic", "audit_bank",
                 "curriculum_env", "rolling_curve", "eval_log", "parse_eval_ends", "score_completions_curriculum", "grade", "grade_empty",
                 "reward_log_files", "decode_results", "validate_bank", "score_stream"]


def _duck(sf_dir):
    con = duckdb.connect()
    for t in ["lineitem", "conversations", "events", "documents"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle_subset(spark, name):
    con = _duck(SF_SMALL)
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    a = sorted(tuple(repr(r[c]) for c in cols) for r in df.select(*cols).collect())
    at = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(repr(r[i]) for i in at) for r in rel.fetchall())
    assert a == b


def test_replay_stream_equals_batch(spark):
    from faultlens.operators.negotiate import replay
    from faultlens.streaming.stream import replay_stream

    bank = B.lineitem_bank(spark, SF_SMALL)
    att = B.drawn_attempts(bank, 42)
    src = tempfile.mkdtemp(prefix="faultlens-att-src-")
    for lo, hi in ((0, 1), (1, 2), (2, 9)):  # attempts arrive turn by turn
        att.where((F.col("attempt_no") > lo) & (F.col("attempt_no") <= hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(att.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = drained(replay_stream(stream, bank))
    batch = replay(att, bank)
    cols = batch.columns
    a = sorted(tuple(r) for r in out.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.collect())
    assert a == b and len(a) > 0


def test_replay_state_is_dropped_on_timeout():
    import pandas as pd

    from faultlens.streaming.stream import _replay_fn

    class State:
        exists = hasTimedOut = False
        removed, duration = False, None

        def update(self, value):
            self.value = value

        def remove(self):
            self.removed = True

        def setTimeoutDuration(self, ms):
            self.duration = ms

    row = dict(attempt_no=1, action_type="submit", gated=False, accepted=False, violated_rule=None, feedback=None,
               loc=1.0, blame=1.0, fix=0.5, total_1=0.9, total_2=0.8, total_0=0.7)
    state = State()
    out = next(_replay_fn(("e",), iter([pd.DataFrame([row])]), state, 60_000))
    assert out.reward.tolist() == [0.7] and state.duration == 60_000 and not state.removed
    state.hasTimedOut = True
    assert list(_replay_fn(("e",), iter([]), state, 60_000)) == [] and state.removed

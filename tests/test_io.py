"""Round trips for the bank and reward-log sources (S1-S4) and eval logs."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultlens.plans import bindings as B
from faultlens.plans import queries as Q
from faultlens.sources import io
from faultlens.sources.evallog import format_eval_log, parse_eval_ends, parse_eval_log, read_eval_log, write_eval_log


def test_bank_roundtrip_json_and_partitioned_parquet(spark):
    bank = B.lineitem_bank(spark, SF_SMALL)
    cols = [f.name for f in io.EPISODE.fields]
    d = tempfile.mkdtemp(prefix="faultlens-io-")
    io.write_bank(bank.select(*cols), f"{d}/json", fmt="json")
    back = io.read_bank(spark, f"{d}/json", fmt="json", multiline=False)
    assert back.count() == bank.count()
    assert back.where(F.col("bank_pos").isNull()).count() == 0
    io.write_bank(bank, f"{d}/pq", fmt="parquet", partition_by_level=True)
    lvl2 = io.read_bank(spark, f"{d}/pq", fmt="parquet").where("curriculum_level = 2")
    assert "PartitionFilters: [isnotnull(curriculum_level" in lvl2._jdf.queryExecution().executedPlan().toString()
    assert lvl2.count() == bank.where("curriculum_level = 2").count()


def test_reward_log_variants_unify(spark):
    log = B.events_reward_log(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="faultlens-log-")
    io.write_log(log.select("step", "level", "pipeline_id", "r_loc", "r_blame", "r_fix", "r_prec", "r_total"), f"{d}/a")
    io.write_log(log.drop("pipeline_id"), f"{d}/b")
    out = io.read_log(spark, f"{d}/a", f"{d}/b")
    assert out.columns == [f.name for f in io.REWARD_LOG.fields]
    assert out.count() == 2 * log.count()
    assert out.where(F.col("run_id").isNull()).count() == 0
    assert out.select("run_id").distinct().count() == 9  # the first log is one run of its own
    named = io.read_log(spark, f"{d}/a", run_ids=[77])
    assert {r.run_id for r in named.select("run_id").distinct().collect()} == {77}


def test_bank_from_one_json_array_and_a_missing_one(spark):
    import json

    bank = B.lineitem_bank(spark, SF_SMALL).orderBy("bank_pos").limit(20)  # without an order a limit may differ each time
    cols = [f.name for f in io.EPISODE.fields]
    rows = [json.loads(r) for r in bank.select(*cols).toJSON().collect()]
    path = tempfile.mkdtemp(prefix="faultlens-array-") + "/bank.json"
    with open(path, "w") as f:
        json.dump(rows, f, indent=1)
    back = io.read_bank(spark, path)
    key = lambda df: sorted(str(tuple(r)) for r in df.select("bank_pos", *cols).collect())
    assert key(back) == key(bank)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_bank(spark, path + ".none").count()
    from faultlens.operators.grader import grade

    default = grade(io.read_bank(spark, path + ".none", missing_ok=True)).collect()
    assert [(r.level, r.total, r.precision, r.pipeline_id) for r in sorted(default)] == [(lv, 0.05, 0.5, None) for lv in (1, 2, 3)]


def test_malformed_lines_do_not_end_the_job(spark):
    lines = [
        "[START] task=t env=e model=m", "[STEP]  step=1 action=fault_step=2,role=Coder reward=0.5000 done=false error=null",
        "[STEP]  step=2 action=fault_step=x,role= reward=1.2.3 done=maybe error=", "[STEP]  step=3 action=fault_step=1,role=Analyst reward=0.1000 done=true error=it broke here",
        "[END]   success=false steps=0 score=0.0 rewards= error=model gave up", "[END] nonsense", "noise",
    ]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "task string, seq int, line string")
    got = [(r.step_no, r.reward, r.error, r.parsed) for r in parse_eval_log(df).collect()]
    assert got == [(1, 0.5, None, True), (None, None, None, False), (3, 0.1, "it broke here", True)]
    ends = [(r.task, r.success, r.steps, r.score, r.rewards, r.error, r.parsed) for r in parse_eval_ends(df).collect()]
    assert ends == [("t", False, 0, 0.0, [], "model gave up", True), ("t", None, None, None, None, None, False)]


def test_elapsed_minutes(spark):
    from faultlens.operators.audit import run_status

    log = spark.createDataFrame([(1, 1, 1, 0.5, "2024-01-01 00:00:00"), (1, 2, 2, 0.7, "2024-01-01 00:45:30")],
                                "run_id long, step long, level int, r_total double, at string").withColumn("at", F.col("at").cast("timestamp"))
    r = run_status(log, 10, time_col="at").first()
    assert (r.completions, r.level, r.elapsed_minutes, r.planned_total) == (2, 2, 45.5, 10)


def test_eval_log_write_read_parse(spark):
    log = B.events_reward_log(spark, SF_SMALL)
    steps = log.select(
        F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("task"),
        F.col("step").alias("step_no"), "predicted_step", "predicted_role", F.col("r_total").alias("reward"),
    ).where("step <= 10")
    lines = format_eval_log(steps)
    d = tempfile.mkdtemp(prefix="faultlens-eval-")
    write_eval_log(lines, f"{d}/logs")
    parsed = parse_eval_log(read_eval_log(spark, f"{d}/logs"), group_col="source")
    direct = parse_eval_log(lines)
    a = sorted(tuple(r) for r in parsed.collect())
    b = sorted(tuple(r) for r in direct.collect())
    assert a == b and len(a) == steps.count()


def test_many_logs_of_mixed_layouts_in_one_scan(spark, tmp_path):
    """Hundreds of files, layouts of their own, read without a job before the first action,
    in batch and as a stream."""
    import random

    rng = random.Random(1)
    names = [f.name for f in io.REWARD_LOG.fields]
    want = []
    (tmp_path / "logs").mkdir()
    for i in range(300):
        held = rng.sample([n for n in names if n != "run_id"], rng.randint(1, 12))
        held += ["step"] * ("step" not in held) + ["run_id"] * (i % 3 == 0)
        rng.shuffle(held)
        out = [",".join(held)]
        for s in range(1, rng.randint(1, 6)):
            row = {"step": s, "run_id": 1000 + i, "level": 1, "pipeline_id": 'say "a,b"' if i % 5 == 0 else f"p{s}", "true_role": "Coder", "predicted_role": None}
            row |= {n: 0.5 * s for n in names if n.startswith("r_")} | {"predicted_step": s, "true_step": 2}
            quoted = lambda v: "" if v is None else '"%s"' % v.replace('"', '\\"') if isinstance(v, str) and "," in v else str(v)
            out.append(",".join(quoted(row[n]) for n in held))
            want.append(tuple(row[n] if n in held else None for n in names if n != "run_id"))
        (tmp_path / "logs" / f"run-{i}.csv").write_text("\r\n".join(out) + "\n" if i % 2 else "\n".join(out))
    (tmp_path / "logs" / "empty.csv").write_text("")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("logs"))
    spark.sparkContext.setJobGroup("logs", "reading logs")
    got = io.read_log(spark, f"{tmp_path}/logs/*.csv")
    assert jobs() <= 1  # Spark may list many paths in a job
    plain = sorted(map(repr, want))
    assert sorted(repr(tuple(r)) for r in got.drop("run_id").collect()) == plain
    ids = got.where("run_id < 1300 and run_id >= 1000").select("run_id").distinct().count()
    others = got.where("run_id >= 1300 or run_id < 1000").select("run_id").distinct().count()
    assert ids <= 100 and others <= 200 and ids + others > 200  # a file without a run id is a run
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") <= 2
    d = tempfile.mkdtemp(prefix="faultlens-logs-")
    from faultlens.streaming.stream import run_to_parquet

    streamed = run_to_parquet(io.stream_log(spark, f"{tmp_path}/logs/*.csv"), f"{d}/out", f"{d}/progress")
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, got.collect()))


def test_a_log_without_a_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="no header"):
        io.read_log(spark, f"{tmp_path}/a.csv").collect()


def test_a_packed_bank_holds_the_same_rows(spark):
    step = lambda i, t: (i, ["Researcher", "Coder", None][i % 3], t)
    clean, odd = [step(1, "a b"), step(2, "c < d"), step(3, None)], [(2, "Coder", "x"), (1, None, "y")]
    told = "Inverted logic at step 2 (Analyst)"
    rows = [
        ("p_1_err_0", 1, "t", "d", clean, [clean[0], step(2, "c > d"), clean[2]], 2, clean[1][1], "logic_inversion", told, "c < d", "c > d", ["c"]),
        ("p_1_err_1", 1, "t", "d", clean, odd, 2, "Nobody", "logic_inversion", None, "other", "c > d", []),
        ("p_1_err_2", None, None, None, clean, clean, 0, None, "unknown", "", None, None, None),
        ("p_1_err_3", 3, "t", "d", clean, None, 9, "Coder", "wrong_type", told, "", "z", [None]),
        ("odd", 3, "t", "d", None, [], None, None, None, None, None, "z", ["", "z"]),
    ]
    bank = spark.createDataFrame(rows, io.EPISODE)
    packed = io.pack_bank(bank)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(io.unpack_bank(packed)) == key(bank) and io.unpack_bank(packed).columns == bank.columns
    good = B.lineitem_bank(spark, SF_SMALL).select(*bank.columns)
    follows = ("original_output", "injected_role", "error_description", "corrupted_pipeline")
    assert io.pack_bank(good).where(" OR ".join(f"{c} IS NOT NULL" for c in follows)).count() == 0
    assert key(io.unpack_bank(io.pack_bank(good))) == key(good)


def test_a_share_of_the_bank_is_json_at_a_time(spark):
    import os

    from faultlens.session import ensure_checkpoint_dir

    back = Q.REGISTRY["bank_json"](spark, SF_SMALL)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("faultlens-bank-json")]  # gone when its rows are read
    assert sorted(map(repr, back.collect())) == sorted(map(repr, Q.bank_columns(Q._bank(spark, SF_SMALL)).collect()))

"""Evaluation log lines (S5) and their parser.

Format per task::

    [START] task=<name> env=<env> model=<model>
    [STEP]  step=<n> action=fault_step=<s>,role=<r> reward=<0.0000> done=<true|false> error=null
    [END]   success=true steps=<n> score=<score> rewards=<r1,r2,...>

A task that failed has no step lines and ends with::

    [END]   success=false steps=0 score=0.0 rewards= error=<text>

Numbers are printed from integer basis points, so ``0.1200`` in the step
lines and ``0.12`` for the score come out exactly as Python's ``:.4f`` and
``str(round(x, 4))`` print them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.operators.audit import bp, fmt4


def py_str4(bp_col: Column) -> Column:
    """``str(round(x, 4))`` for a non-negative value given in basis points."""
    frac = F.regexp_replace(F.lpad(F.pmod(bp_col, F.lit(10000)).cast("string"), 4, "0"), "0+$", "")
    return F.concat((bp_col / 10000).cast("bigint").cast("string"), F.lit("."),
                    F.when(frac == "", F.lit("0")).otherwise(frac))


def format_eval_log(steps: DataFrame, model: str = "baseline_random", env: str = K.DEFAULT_ENV_NAME,
                    error_col: str | None = None) -> DataFrame:
    """``steps(task, step_no, predicted_step, predicted_role, reward)`` ->
    ``(task, seq, line)``; seq 0 is START, 1..n the steps, then END.

    With ``error_col``, a task with an error text has failed: its END says so,
    with the text of its first such step, and it has no step lines. Tasks are
    small (the evaluation loop caps them at 10 steps), so the END line's reward
    list is built inside one task group."""
    err = F.col(error_col).cast("string") if error_col else F.lit(None).cast("string")
    s = steps.withColumn("_bp", bp(F.col("reward"))).withColumn("_err", err)
    per = s.groupBy("task").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_bp").alias("_sum"),
        F.max("step_no").alias("_last"),
        F.min_by("_err", F.when(F.col("_err").isNotNull(), F.col("step_no"))).alias("_error"),
        F.array_sort(F.collect_list(F.struct(F.col("step_no").alias("s"), F.col("_bp").alias("b")))).alias("_rs"),
    )
    start = per.select("task", F.lit(0).cast("bigint").alias("seq"),
                       F.concat(F.lit("[START] task="), F.col("task"), F.lit(f" env={env} model={model}")).alias("line"))
    step_lines = s.join(per.where(F.col("_error").isNull()).select("task", "_last"), "task").select(
        "task",
        F.col("step_no").cast("bigint").alias("seq"),
        F.concat(
            F.lit("[STEP]  step="), F.col("step_no").cast("string"),
            F.lit(" action=fault_step="), F.col("predicted_step").cast("string"),
            F.lit(",role="), F.col("predicted_role"),
            F.lit(" reward="), fmt4(F.col("_bp")),
            F.lit(" done="), F.when(F.col("step_no") == F.col("_last"), "true").otherwise("false"),
            F.lit(" error=null"),
        ).alias("line"),
    )
    score_bp = F.floor(F.col("_sum").cast("double") / F.col("_n").cast("double") + F.lit(0.5)).cast("bigint")
    done = F.concat(
        F.lit("[END]   success=true steps="), F.col("_n").cast("string"),
        F.lit(" score="), py_str4(score_bp),
        F.lit(" rewards="), F.array_join(F.transform("_rs", lambda x: fmt4(x["b"])), ","),
    )
    failed = F.concat(F.lit("[END]   success=false steps=0 score=0.0 rewards= error="), F.col("_error"))
    end = per.select(
        "task", (F.col("_last") + 1).cast("bigint").alias("seq"),
        F.when(F.col("_error").isNull(), done).otherwise(failed).alias("line"),
    )
    return start.unionByName(step_lines).unionByName(end)


def write_eval_log(lines: DataFrame, path: str) -> None:
    """Write the lines as text. Each task's lines (a bounded block: the loop
    caps a task at 10 steps) are folded into one row in sequence order, so a
    task never straddles two files whatever the partitioning."""
    blocks = lines.groupBy("task").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]),
                     "\n").alias("block")
    )
    blocks.select("block").write.mode("overwrite").text(path)


STEP_RE = r"^\[STEP\]\s+step=(\d+) action=fault_step=(-?\d+),role=(\S*) reward=([0-9.]+) done=(true|false) error=(.*)$"
START_RE = r"^\[START\] task=(\S+) env=(\S+) model=(\S+)$"
END_RE = r"^\[END\]\s+success=(true|false) steps=(\d+) score=([0-9.]+) rewards=(\S*)(?: error=(.*))?$"


def _with_task(lines: DataFrame, group_col: str, seq_col: str, line_col: str) -> DataFrame:
    """Lines with the task of the last START line before them in their group."""
    w = Window.partitionBy(group_col).orderBy(seq_col).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("_l").startswith("[START]") & F.col("_l").rlike(START_RE), F.regexp_extract("_l", START_RE, 1))
    lines = lines.select(group_col, seq_col, F.col(line_col).alias("_l"))
    return lines.withColumn("_task", F.last(named, ignorenulls=True).over(w))


def _field(pattern: str, i: int, kind: str = "string") -> Column:
    """Group ``i`` of the line, NULL where the line (``_ok`` tells) or the value is malformed."""
    return F.when(F.col("_ok"), F.regexp_extract("_l", pattern, i)).try_cast(kind)


def parse_eval_log(lines: DataFrame, group_col: str = "task", seq_col: str = "seq", line_col: str = "line") -> DataFrame:
    """STEP lines -> rows with the task taken from the START line of the
    same group (a file, or a task when lines carry it), rewards as DOUBLE, and
    the error text (NULL for ``null``). A malformed line stays a row: its fields
    are NULL, ``parsed`` is false and ``line`` holds it.

    ``lines`` needs a group column and a sequence inside it (for files: the
    source and the position in it, see ``read_eval_log``)."""
    st = _with_task(lines, group_col, seq_col, line_col).where(F.col("_l").startswith("[STEP]")).withColumn("_ok", F.col("_l").rlike(STEP_RE))
    step, reward = _field(STEP_RE, 1, "bigint"), _field(STEP_RE, 4, "double")
    return st.select(
        F.col("_task").alias("task"),
        step.alias("step_no"),
        _field(STEP_RE, 2, "bigint").alias("predicted_step"),
        _field(STEP_RE, 3).alias("predicted_role"),
        reward.alias("reward"),
        (_field(STEP_RE, 5) == "true").alias("done"),
        F.nullif(_field(STEP_RE, 6), F.lit("null")).alias("error"),
        (step.isNotNull() & reward.isNotNull()).alias("parsed"),
        F.col("_l").alias("line"),
    )


def parse_eval_ends(lines: DataFrame, group_col: str = "task", seq_col: str = "seq", line_col: str = "line") -> DataFrame:
    """END lines -> ``(task, success, steps, score, rewards, error, parsed)``, with
    rewards as an array of DOUBLE; malformed lines as in ``parse_eval_log``."""
    ends = _with_task(lines, group_col, seq_col, line_col).where(F.col("_l").startswith("[END]")).withColumn("_ok", F.col("_l").rlike(END_RE))
    listed = _field(END_RE, 4)
    rewards = F.when(listed == "", F.array().cast("array<double>")).otherwise(
        F.transform(F.split(listed, ","), lambda x: x.try_cast("double"))
    )
    score = _field(END_RE, 3, "double")
    return ends.select(
        F.col("_task").alias("task"),
        (_field(END_RE, 1) == "true").alias("success"),
        _field(END_RE, 2, "bigint").alias("steps"),
        score.alias("score"),
        rewards.alias("rewards"),
        F.nullif(_field(END_RE, 5), F.lit("")).alias("error"),
        score.isNotNull().alias("parsed"),
    )


def read_eval_log(spark, path: str) -> DataFrame:
    """Read eval-log files line by line as ``(source, seq, line)``: the file, and the
    line's order in it (a large file is read in splits, ordered by their start)."""
    lines = spark.read.text(path).where(F.col("value") != "")
    return lines.select(
        F.col("_metadata.file_path").alias("source"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("seq"),
        F.col("value").alias("line"),
    )

"""Aggregations, audits and reports.

Means over rewards are computed from integer units of 1e-12
(``floor(r * 1e12 + 0.5)``, summed as DECIMAL(38,0)): finer than any reward the
trainers log, sums are exact and independent of partitioning and merge order,
and the single final division gives the same double on any engine. Printed
rewards have four decimals and use basis points. χ² is likewise formed from an
exact integer numerator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import safe_size
from faultlens.operators.traces import trace_length

#: Units of exact reward sums.
UNIT = 10**12


def bp(c: Column) -> Column:
    """Reward in integer basis points."""
    return F.floor(c * F.lit(10000.0) + F.lit(0.5)).cast("bigint")


def units(c: Column) -> Column:
    """Reward in integer units of 1e-12."""
    return F.floor(c * F.lit(float(UNIT)) + F.lit(0.5)).cast("bigint")


def unit_sum(c: Column) -> Column:
    """Aggregate: exact sum of a reward column in units, of any number of rows."""
    return F.sum(units(c).cast("decimal(38,0)"))


def unit_mean(c: Column) -> Column:
    """Aggregate: mean of a reward column via exact sums (NULL for an empty group)."""
    return unit_sum(c).cast("double") / F.count(c).cast("double") / F.lit(float(UNIT))


# ---------------------------------------------------------------------------
# G1, V3
# ---------------------------------------------------------------------------

BANK_DIMENSIONS = {
    "curriculum_level": "curriculum_level",
    "injected_step": "injected_step",
    "injected_role": "injected_role",
    "error_type": "error_type",
    "domain": "domain",
}


def bank_stats(bank: DataFrame) -> DataFrame:
    """G1: counts by level / step / role / error type / domain plus totals,
    long form ``(dimension, value, n)``, from one grouping-sets pass; the
    distinct id count is one more partial aggregate."""
    dims = list(BANK_DIMENSIONS)
    b = bank.select(*[F.col(d).cast("string").alias(d) for d in dims])
    sets = [[F.col(d)] for d in dims] + [[]]
    g = b.groupingSets(sets, *dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    nd = len(dims)
    dim_name = F.lit("total")
    value = F.lit("all")
    for i, d in enumerate(dims):
        gid_of_d = (1 << nd) - 1 - (1 << (nd - 1 - i))
        dim_name = F.when(F.col("_gid") == gid_of_d, F.lit(d)).otherwise(dim_name)
        value = F.when(F.col("_gid") == gid_of_d, F.col(d)).otherwise(value)
    long = g.select(dim_name.alias("dimension"), value.alias("value"), F.col("n").cast("bigint").alias("n"))
    uniq = bank.agg(F.count_distinct("pipeline_id").cast("bigint").alias("n")).select(
        F.lit("unique_ids").alias("dimension"), F.lit("all").alias("value"), "n"
    )
    return long.unionByName(uniq)


def validate_bank(bank: DataFrame) -> DataFrame:
    """V3: one row per finding ``(pipeline_id, finding)``: missing required
    fields (``domain`` is not required), empty keyword lists, and one
    aggregate row when ids are duplicated."""
    # a projection of its own, so that each field is formed once for its check
    checked = bank.select(
        F.coalesce(F.col("pipeline_id"), F.lit("UNKNOWN")).alias("pipeline_id"),
        F.concat_ws(", ", *[F.when(F.col(f).isNull(), F.lit(f)) for f in K.REQUIRED_FIELDS]).alias("_missing"),
        (safe_size(F.col("expected_fix_keywords")) == 0).alias("_empty"),
    )
    found = F.array(
        F.when(F.col("_missing") != "", F.concat(F.lit("missing fields: "), "_missing")),
        F.when(F.col("_empty"), F.lit("empty expected_fix_keywords")),
    )
    # an inner explode would have its filter pushed down, where all fields are formed once more
    per_row = checked.select("pipeline_id", F.explode_outer(found).alias("finding")).where("finding IS NOT NULL")
    dup = (
        bank.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("pipeline_id").alias("_u"))
        .where(F.col("_n") != F.col("_u"))
        .select(
            F.lit(None).cast("string").alias("pipeline_id"),
            F.format_string("Duplicate IDs found: %d episodes but %d unique IDs", "_n", "_u").alias("finding"),
        )
    )
    return per_row.unionByName(dup)


# ---------------------------------------------------------------------------
# G2-G8 audit checks
# ---------------------------------------------------------------------------


def step_uniformity(bank: DataFrame, include_zero: bool = False) -> DataFrame:
    """χ² of injected steps per pipeline length over observed steps
    (``include_zero`` adds never-hit steps). status ok < 20 <= warn < 50 <= fail.

    χ² = Σ (L·obs − N)² / (L·N) with an integer numerator."""
    per = (
        bank.select(trace_length(bank).alias("plen"), "injected_step")
        .groupBy("plen", "injected_step")
        .agg(F.count(F.lit(1)).alias("obs"))
    )
    if include_zero:
        n_by_len = per.groupBy("plen").agg(F.sum("obs").alias("_n"))
        spine = n_by_len.select("plen", F.explode(F.sequence(F.lit(1), F.col("plen"))).alias("injected_step"))
        per = spine.join(per, ["plen", "injected_step"], "left").fillna(0, ["obs"])
    tot = per.groupBy("plen").agg(F.sum("obs").alias("n_episodes"))
    d = per.join(tot, "plen")
    d = d.withColumn("_dev", (F.col("plen") * F.col("obs") - F.col("n_episodes")).cast("decimal(38,0)"))
    res = d.groupBy("plen", "n_episodes").agg(
        F.sum(F.col("_dev") * F.col("_dev")).alias("_num"), F.count(F.lit(1)).alias("steps_seen")
    )
    chi2 = F.col("_num").cast("double") / (F.col("plen") * F.col("n_episodes")).cast("double")
    return res.select(
        F.col("plen").cast("int").alias("plen"),
        F.col("n_episodes").cast("bigint").alias("n_episodes"),
        F.col("steps_seen").cast("bigint").alias("steps_seen"),
        chi2.alias("chi2"),
        F.when(chi2 < 20, "ok").when(chi2 < 50, "warn").otherwise("fail").alias("status"),
    )


def role_share(bank: DataFrame, limit_pct: float = 60.0) -> DataFrame:
    """Share of injected roles in percent, flagged above ``limit_pct``."""
    total = bank.select(F.count(F.lit(1))).scalar()
    g = bank.groupBy("injected_role").agg(F.count(F.lit(1)).alias("n"))
    pct = F.col("n").cast("double") * F.lit(100.0) / total.cast("double")
    return g.select("injected_role", F.col("n").cast("bigint").alias("n"), pct.alias("pct"),
                    (pct <= F.lit(limit_pct)).alias("within_limit"))


def error_mix(bank: DataFrame) -> DataFrame:
    """Error types per level (long form)."""
    return bank.groupBy("curriculum_level", "error_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def keyword_quality(bank: DataFrame) -> DataFrame:
    """Rows with an empty keyword list; rows whose keywords are all <= 2
    characters."""
    kw = F.col("expected_fix_keywords")
    return bank.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_episodes"),
        F.count_if(safe_size(kw) == 0).cast("bigint").alias("empty_keywords"),
        F.count_if((safe_size(kw) > 0) & F.forall(kw, lambda k: F.length(k) <= 2)).cast("bigint").alias(
            "trivial_keywords"
        ),
    )


def noop_corruptions(bank: DataFrame) -> DataFrame:
    """Episodes whose corruption changed nothing (null-safe equality)."""
    return bank.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_episodes"),
        F.count_if(F.col("original_output").eqNullSafe(F.col("corrupted_output"))).cast("bigint").alias("identical"),
    )


def constant_guess_rate(bank: DataFrame, by: str = "injected_step", limit: float = 0.40) -> DataFrame:
    """Share of episodes a constant guess of each value would hit; the
    original check (step 1) must stay below ``limit``."""
    total = bank.select(F.count(F.lit(1))).scalar()
    g = bank.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n").cast("double") / total.cast("double")
    return g.select(F.col(by).cast("string").alias("guess"), F.col("n").cast("bigint").alias("n"),
                    share.alias("share"), (share < F.lit(limit)).alias("passes"))


def audit_bank(bank: DataFrame) -> DataFrame:
    """All checks as ``(check, subject, value, status)``, from one pass over the
    bank: a partial aggregate by trace length, step, role, level and error type
    (a few hundred groups at most, whatever the bank's size) holds the counts
    of every check."""
    kw = F.col("expected_fix_keywords")
    cells = bank.groupBy(
        F.size("corrupted_pipeline").alias("plen"), "injected_step", "injected_role", "curriculum_level", "error_type"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(safe_size(kw) == 0).alias("empty"),
        F.count_if((safe_size(kw) > 0) & F.forall(kw, lambda k: F.length(k) <= 2)).alias("trivial"),
        F.count_if(F.col("original_output").eqNullSafe(F.col("corrupted_output"))).alias("identical"),
    )
    sets = [["plen", "injected_step"], ["plen"], ["injected_role"], ["curriculum_level", "error_type"], ["injected_step"], []]
    dims = ["plen", "injected_step", "injected_role", "curriculum_level", "error_type"]
    g = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(
        *[F.sum(c).alias(c) for c in ("n", "empty", "trivial", "identical")], F.grouping_id().alias("_gid")
    )
    gid = {tuple(s): sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s) for s in sets}
    # all but the step cells are compared to a total: arrays of a few hundred structs in one row
    row = F.struct(*dims, "n", "empty", "trivial", "identical", "_gid")
    one = g.agg(F.collect_list(row).alias("c"))

    def of(*s):
        return F.filter("c", lambda x: x["_gid"] == gid[s])

    def line(check, subject, value, status):
        return F.struct(F.lit(check).alias("check"), subject.alias("subject"), value.cast("double").alias("value"), status.alias("status"))

    total = of()[0]
    s = lambda c: c.cast("string")

    def uniformity(t):
        here = F.filter(of("plen", "injected_step"), lambda x: x["plen"] == t["plen"])
        num = F.aggregate(here, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (
            acc + ((t["plen"] * x["n"] - t["n"]).cast("decimal(19,0)") * (t["plen"] * x["n"] - t["n"]).cast("decimal(19,0)"))
        ).cast("decimal(38,0)"))
        chi2 = num.cast("double") / (t["plen"] * t["n"]).cast("double")
        status = F.when(chi2 < 20, "ok").when(chi2 < 50, "warn").otherwise("fail")
        return line("step_uniformity", F.concat(F.lit("plen="), s(t["plen"])), chi2, status)

    def share(x):
        pct = x["n"].cast("double") * F.lit(100.0) / total["n"].cast("double")
        return line("role_share", x["injected_role"], pct, F.when(pct <= F.lit(60.0), "ok").otherwise("warn"))

    def mix(x):
        subject = F.concat(F.lit("level="), s(x["curriculum_level"]), F.lit(" "), x["error_type"])
        return line("error_mix", subject, x["n"], F.lit("info"))

    def guess(x):
        part = x["n"].cast("double") / total["n"].cast("double")
        return line("constant_guess", F.lit("step=1"), part, F.when(part < F.lit(0.40), "ok").otherwise("fail"))

    def zero(check, subject, field):
        return line(check, F.lit(subject), total[field], F.when(total[field] == 0, "ok").otherwise("warn"))

    fixed = F.array(
        zero("keyword_quality", "empty", "empty"), zero("keyword_quality", "trivial", "trivial"),
        zero("noop_corruptions", "identical", "identical"),
    )
    lines = F.concat(
        F.transform(of("plen"), uniformity), F.transform(of("injected_role"), share),
        F.transform(of("curriculum_level", "error_type"), mix), fixed,
        F.transform(F.filter(of("injected_step"), lambda x: x["injected_step"] == 1), guess),
    )
    return one.select(F.inline(lines))


# ---------------------------------------------------------------------------
# G9-G14 reports
# ---------------------------------------------------------------------------


def mean_by_level(log: DataFrame, level_col: str = "level", cols: Sequence[str] = ("r_total",)) -> DataFrame:
    """Mean reward(s) per level."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n")] + [unit_mean(F.col(c)).alias(f"mean_{c}") for c in cols]
    return log.groupBy(level_col).agg(*aggs)


def target_check(scores: DataFrame, level_col: str = "level", score_col: str = "score") -> DataFrame:
    """Compare per-level scores with the targets (> 0.4 / 0.6 / 0.7)."""
    spark = scores.sparkSession
    targets = spark.createDataFrame(
        [(lvl, float(t)) for lvl, t in K.TARGET_MEAN_BY_LEVEL.items()], f"{level_col} int, target double"
    )
    return scores.join(F.broadcast(targets), level_col, "left").withColumn(
        "meets_target", F.col(score_col) > F.col("target")
    )


def fmt4(b: Column) -> Column:
    """``f"{x:.4f}"`` for a non-negative value given in basis points."""
    return F.concat((b / 10000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad(F.pmod(b, F.lit(10000)).cast("string"), 4, "0"))


def task_score(steps: DataFrame, task_col: str = "task", step_col: str = "step_no", reward_col: str = "reward",
               error_col: str | None = None) -> DataFrame:
    """Per task - mean reward (4 decimals), step count, success flag, the
    comma-joined 4-decimal reward list in step order, and the error text.

    With ``error_col``, a task with an error text has failed: no steps, score 0
    and no rewards count, as the evaluation loop prints it; the text is that of
    its first such step. The list is the task's own rewards (bounded by the
    per-task step cap of the evaluation loop), sorted by step in the aggregate."""
    err = F.col(error_col) if error_col else F.lit(None).cast("string")
    g = steps.groupBy(task_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("_n"),
        F.sum(bp(F.col(reward_col))).alias("_bp"),
        F.array_sort(F.collect_list(F.struct(F.col(step_col).alias("s"), F.col(reward_col).alias("r")))).alias("_rs"),
        F.min_by(err, F.when(err.isNotNull(), F.col(step_col))).alias("error"),
    )
    ok = F.col("error").isNull()
    score = F.floor(F.col("_bp").cast("double") / F.col("_n").cast("double") + F.lit(0.5)).cast("double") / F.lit(10000.0)
    return g.select(
        task_col,
        F.when(ok, F.col("_n")).otherwise(F.lit(0).cast("bigint")).alias("steps"),
        F.when(ok, score).otherwise(F.lit(0.0)).alias("score"),
        ok.alias("success"),
        F.when(ok, F.array_join(F.transform("_rs", lambda x: fmt4(bp(x["r"]))), ",")).otherwise(F.lit("")).alias("rewards"),
        "error",
    )


def run_status(log: DataFrame, planned_total: int | None = None, tail: int = 30, time_col: str | None = None,
               run_col: str = "run_id") -> DataFrame:
    """Per run - completions so far, planned total, mean of the last ``tail``
    rewards (fewer when short), current level; with ``time_col`` also the minutes
    from its first to its last row. A run's size is a partial aggregate joined
    back, so no run meets in one task."""
    from faultlens.operators.curves import with_run_size

    last = with_run_size(log, run_col).where(F.col("step") > F.col("n") - tail)
    tail_mean = last.groupBy(F.col(run_col).alias("_run")).agg(unit_mean(F.col("r_total")).alias("recent_mean"))
    elapsed = []
    if time_col:
        seconds = F.max(time_col).cast("double") - F.min(time_col).cast("double")
        elapsed = [(seconds / F.lit(60.0)).alias("elapsed_minutes")]
    base = log.groupBy(run_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("completions"),
        F.max_by("level", "step").alias("level"),
        *elapsed,
    )
    out = base.join(tail_mean, F.col(run_col).eqNullSafe(F.col("_run")), "left").drop("_run")
    return out.withColumn("recent_mean", F.coalesce("recent_mean", F.lit(0.0))).withColumn(
        "planned_total", F.lit(planned_total).cast("bigint")
    )

"""Projections and trace shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import element

TRUTH_COLUMNS = [
    "clean_pipeline",
    "injected_step",
    "injected_role",
    "error_type",
    "error_description",
    "original_output",
    "corrupted_output",
    "expected_fix_keywords",
]


def trace_length(df: DataFrame) -> Column:
    """Steps of an episode's trace: the stored number, where there is one."""
    return F.col("n_steps") if "n_steps" in df.columns else F.size("corrupted_pipeline")


def kept_words(df: DataFrame) -> list[str]:
    """The column of the original's distinct words, where the bank keeps it."""
    return [c for c in df.columns if c == "original_words"]


def role_for_step(idx0: Column) -> Column:
    """Cyclic role for a 0-based step index (Researcher, Coder, Analyst)."""
    return element(K.ROLES, F.pmod(idx0, F.lit(len(K.ROLES))))


def nest_steps(tr: DataFrame, keys=("trace_id", "curriculum_level", "task_brief", "domain")) -> DataFrame:
    """Long steps -> one row per trace with ``steps`` sorted by step_id.

    The group is one trace, so its size is the trace length, never a whole
    table; the aggregate reuses a partitioning on ``trace_id`` when present.
    """
    return tr.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("step_id", "role", "output"))).alias("steps")
    )


def explode_steps(bank: DataFrame, col: str = "corrupted_pipeline", keep=("pipeline_id",)) -> DataFrame:
    """P4 inverse: one row per step. Steps are marked and the rows of empty traces
    dropped by the mark: of a plain ``inline`` Spark infers a filter on the array's
    size, for which a trace that is formed on read would be formed again."""
    fields = [f.name for f in bank.schema[col].dataType.elementType.fields]
    marked = F.transform(col, lambda s: F.struct(F.lit(True).alias("_step"), *[s[f].alias(f) for f in fields]))
    return bank.select(*keep, F.inline_outer(marked)).where("_step").drop("_step")


def observation_view(bank: DataFrame, turn: Column | int = 1, feedback: Column | None = None) -> DataFrame:
    """What an agent may see - no truth column is selected, so column
    pruning keeps the truth fields out of the scan entirely."""
    return bank.select(
        F.col("corrupted_pipeline").alias("pipeline"),
        "task_brief",
        (turn if isinstance(turn, Column) else F.lit(turn)).alias("turn"),
        (feedback if feedback is not None else F.lit(None).cast("string")).alias("gatekeeper_feedback"),
        "curriculum_level",
        "pipeline_id",
    )


def truth_view(bank: DataFrame) -> DataFrame:
    """Ground truth per episode, joined only where scoring needs it; a bank
    stored without its traces gives the truth without the clean one."""
    truth = [c for c in TRUTH_COLUMNS if c != "clean_pipeline" or c in bank.columns]
    return bank.select("pipeline_id", "curriculum_level", trace_length(bank).alias("n_steps"), *truth, *kept_words(bank))


def render_steps(steps: Column) -> Column:
    """Concatenated ``--- Step i (role) ---`` blocks in step order."""
    return F.array_join(
        F.transform(
            F.array_sort(steps),
            lambda s: F.concat(
                F.lit("\n--- Step "), s["step_id"].cast("string"), F.lit(" ("), s["role"], F.lit(") ---\n"),
                s["output"], F.lit("\n"),
            ),
        ),
        "",
    )


def prompt_column(variant: str = "lenient") -> Column:
    """User prompt of an episode row in one of the two wordings."""
    tmpl = K.PROMPT_USER_LENIENT if variant == "lenient" else K.PROMPT_USER_COMPACT
    head, rest = tmpl.split("{brief}")
    mid, tail = rest.split("{steps}")
    return F.concat(F.lit(head), F.col("task_brief"), F.lit(mid), render_steps(F.col("corrupted_pipeline")), F.lit(tail))


def render_prompt(bank: DataFrame, variant: str = "lenient") -> DataFrame:
    """One prompt per episode; a narrow map."""
    return bank.select("pipeline_id", prompt_column(variant).alias("prompt"))


def to_messages(bank: DataFrame, variant: str = "lenient", name: str = K.DEFAULT_AGENT_NAME) -> DataFrame:
    """Chat messages (system, user) per episode."""
    system = (K.SYSTEM_PROMPT_LENIENT if variant == "lenient" else K.SYSTEM_PROMPT_COMPACT).format(name=name)
    user = render_prompt(bank, variant)
    return user.select(
        "pipeline_id",
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
        ).alias("messages"),
    )


REWARD_COLUMNS = {
    "level": "level", "pipeline_id": "pipeline_id", "localization": "r_loc", "blame": "r_blame", "fix": "r_fix", "precision": "r_prec", "total": "r_total",
    "fault_step_id": "predicted_step", "injected_step": "true_step", "blame_role": "predicted_role", "injected_role": "true_role",
}


def reward_rows(scored: DataFrame, run_col: str = "run_id", order_cols=("completion_no",)) -> DataFrame:
    """Scored answers as reward-log rows without a number, in the order of ``order_cols``."""
    steps = ("fault_step_id", "injected_step")
    return scored.select(F.col(run_col), *order_cols, *[F.col(c).cast("int").alias(to) if c in steps else F.col(c).alias(to) for c, to in REWARD_COLUMNS.items()])


def number_rewards(rows: DataFrame, run_col: str = "run_id", order_cols=("completion_no",)) -> DataFrame:
    """``reward_rows`` with a running step number per run, numbered by range
    pieces, so a run of any size is spread over tasks."""
    from faultlens.plans.dense import dense_index

    return dense_index(rows, [run_col], list(order_cols), "step").select(run_col, "step", *REWARD_COLUMNS.values())


def to_reward_log(scored: DataFrame, run_col: str = "run_id", order_cols=("completion_no",)) -> DataFrame:
    """Reward-log rows with a running step number per run."""
    by = [f"_by_{c}" for c in order_cols]
    named = scored.withColumns({b: F.col(c) for b, c in zip(by, order_cols, strict=True)})
    return number_rewards(reward_rows(named, run_col, by), run_col, by)

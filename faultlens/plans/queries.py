"""Registered queries: each takes ``(spark, sf_dir)`` and returns a
DataFrame over the whole driver tables. Column names and types match the
DuckDB oracles in ``oracle/queries.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import tokens
from faultlens.operators import actions as A
from faultlens.operators import audit as G
from faultlens.operators import curves as W
from faultlens.operators import gate as V
from faultlens.operators import inject as I
from faultlens.operators import negotiate as N
from faultlens.operators import sampling as X
from faultlens.operators import score as R
from faultlens.operators import traces as P
from faultlens.operators.grader import grade
from faultlens.operators.incremental import CurveStore
from faultlens.operators.training import score_with_curriculum
from faultlens.plans import bindings as B
from faultlens.plans.materialize import materialize, materialize_shares, passing, scratch_path, shuffles_dropped
from faultlens.sources import evallog as E
from faultlens.sources import io
from faultlens.streaming.events import CurriculumBatches, ReplayBatches, score_as_truth_comes, state_in_zstd
from faultlens.streaming.stream import curriculum_stream, run_to_parquet, score_stream

SEED = 42


def bank_columns(bank: DataFrame) -> DataFrame:
    """Flat, comparable projection of an episode bank."""
    return bank.select(
        "bank_pos",
        "pipeline_id",
        "curriculum_level",
        "task_brief",
        "domain",
        F.size("corrupted_pipeline").cast("int").alias("n_steps"),
        "injected_step",
        "injected_role",
        "error_type",
        "error_description",
        "original_output",
        "corrupted_output",
        F.array_join("expected_fix_keywords", "|").alias("keywords"),
        F.array_join(F.transform("corrupted_pipeline", lambda x: x["output"]), "\n<>\n").alias("corrupted_text"),
        F.array_join(F.transform("clean_pipeline", lambda x: x["output"]), "\n<>\n").alias("clean_text"),
    )


def _bank(spark, sf_dir):
    """The lineitem bank, stored once per session and directory."""
    return B.lineitem_bank(spark, sf_dir, SEED)


def _truth(spark, sf_dir):
    """The same episodes as answers meet them, in buckets of the episode and without traces."""
    return B.lineitem_truth(spark, sf_dir, SEED)


def _both(spark, sf_dir) -> DataFrame:
    return _bank(spark, sf_dir).unionByName(B.conversation_bank(spark, sf_dir, SEED))


def _acted(spark, sf_dir) -> DataFrame:
    """B4 actions joined to the truth of their episodes (as answers arrive
    separately from the bank)."""
    return B.lineitem_answered(spark, sf_dir, SEED)


# ---------------------------------------------------------------------------
# Injection and keywords
# ---------------------------------------------------------------------------


def q_bank_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1-I9, K1-K5, P3-P5 on B1 traces."""
    return bank_columns(_bank(spark, sf_dir))


def q_bank_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1-I9, K1-K5 on multilingual B2 traces (mostly fallback paths)."""
    return bank_columns(B.conversation_bank(spark, sf_dir, SEED))


def q_bank_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3-I9, K2-K5 with swap banks read from a table that has a pair for every part."""
    bank = B.lineitem_bank_of_tables(spark, sf_dir, SEED)
    return bank.select("pipeline_id", "error_type", "corrupted_output", F.array_join("expected_fix_keywords", "|").alias("keywords"))


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------

SCORE_COLS = ["localization", "blame", "fix", "precision", "total"]


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: B1 traces -> episodes -> random baseline agent (X7) ->
    training reward (R5) -> mean reward per level (G10)."""
    acted = X.baseline_actions(_bank(spark, sf_dir), SEED, K.BASELINE_FIX_OFFLINE)
    scored = R.score_total(acted, "train").withColumnRenamed("curriculum_level", "level")
    return G.mean_by_level(scored, "level", ["total", "localization", "blame", "fix"])


def _score_query(variant: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = _acted(spark, sf_dir)
        if variant == "server":
            gated = F.col("action_type").isin("propose", "revise")
            a = V.gate(a).withColumn("_acc", gated & F.col("accepted"))
            s = R.score_total(a, "server", turn=F.lit(1), accepted=F.col("_acc"))
        else:
            s = R.score_total(a, variant)
        return s.select("pipeline_id", *SCORE_COLS)

    q.__doc__ = f"R1-R5, variant {variant}, on drawn actions joined to truth."
    return q


def q_fix_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3a-R3d, R3 (rounded), R3t (unrounded), R3g, R3i per episode."""
    a = _acted(spark, sf_dir)
    fix, o, kw, c, low = (F.col(x) for x in ("fix_content", "original_output", "expected_fix_keywords", "corrupted_output", "_low"))
    # lowered once, and each part formed once for its two sums, in projections of their own
    a = a.withColumn("_low", F.lower("fix_content"))
    a = a.withColumns({
        "keyword_share": R.keyword_share(fix, kw, low=F.coalesce(low, F.lit(""))),
        "not_corrupt": R.not_corrupt(fix, c, low),
        "length_fit": R.length_fit(fix, o),
        "word_overlap": R.word_overlap(fix, o, low, F.col("original_words")),
    })
    parts = ("keyword_share", "not_corrupt", "length_fit", "word_overlap")
    return a.select(
        "pipeline_id",
        *parts,
        R.weighted_fix(fix, *map(F.col, parts), rounded=True).alias("fix_server"),
        R.weighted_fix(fix, *map(F.col, parts), rounded=False).alias("fix_train"),
        R.score_fix_simple(fix, kw, 0.3, True, F.coalesce(low, F.lit(""))).alias("fix_grade"),
        R.score_fix_simple(fix, kw, 0.0, False, F.coalesce(low, F.lit(""))).alias("fix_infer"),
    )


def q_verify_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4 routed by the drawn role (an invalid role takes the generic path)."""
    a = _acted(spark, sf_dir)
    fix, kw = F.col("fix_content"), F.col("expected_fix_keywords")
    return a.select(
        "pipeline_id",
        R.verify_researcher(fix, kw).alias("researcher"),
        R.verify_coder(fix, kw).alias("coder"),
        R.verify_analyst(fix, kw).alias("analyst"),
        R.verify_fix(F.col("blame_role"), fix, kw).alias("routed"),
    )


def q_verify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4 and tokenising on whole multilingual documents (B3): the
    document is the fix text, its logic terms are the keywords."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    # lowered and split once a text, in projections of their own
    d = d.withColumn("_low", F.lower(F.coalesce("text", F.lit("")))).withColumns({"_kw": I.keywords_logic(F.col("text"), F.col("_low")), "_words": F.size(tokens(F.col("text")))})
    role = F.element_at(F.array(*[F.lit(r) for r in K.ROLES + ["Reviewer"]]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    fix, kw, low, words = (F.col(c) for c in ("text", "_kw", "_low", "_words"))
    return d.select(
        "doc_id",
        words.cast("bigint").alias("n_words"),
        R.keyword_share(fix, kw, low=low).alias("keyword_share"),
        R.verify_researcher(fix, kw, low, words).alias("researcher"),
        R.verify_coder(fix, kw, low).alias("coder"),
        R.verify_analyst(fix, kw, low).alias("analyst"),
        R.verify_fix(role, fix, kw, low, words).alias("routed"),
    )


# ---------------------------------------------------------------------------
# Gate and validation
# ---------------------------------------------------------------------------


def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5-V7 on drawn actions."""
    return V.gate(_acted(spark, sf_dir)).select("pipeline_id", "accepted", "violated_rule", "feedback")


def q_validate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 on drawn actions."""
    a = B.drawn_actions(_bank(spark, sf_dir), SEED)
    return V.validate_actions(a).select("pipeline_id", F.array_join("violations", ",").alias("violations"))


def q_validate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 on observations of both banks; turns come from the drawn attempt
    numbers, and some levels are drawn out of range."""
    both = _both(spark, sf_dir)
    att = B.drawn_attempts(both, SEED)
    level = F.when(B.draw(SEED, F.col("pipeline_id"), "badlevel", n=20) == 0, F.lit(4)).otherwise(F.col("curriculum_level"))
    bank = both.select("pipeline_id", level.alias("curriculum_level"))
    obs = att.join(bank, F.col("episode_id") == F.col("pipeline_id")).select(
        "episode_id", "attempt_no", (F.col("attempt_no") - 1).alias("turn"), "curriculum_level"
    )
    return V.validate_observations(obs).select(
        "episode_id", "attempt_no", F.array_join("violations", ",").alias("violations")
    )


def q_validate_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 on the union of both banks with planted faults: findings per episode."""
    return G.validate_bank(B.planted_bank(_both(spark, sf_dir), SEED))


# ---------------------------------------------------------------------------
# Parsing (B6 completions)
# ---------------------------------------------------------------------------


def _parsed(spark, sf_dir, strict: bool) -> DataFrame:
    comp = B.drawn_completions(B.drawn_actions(_bank(spark, sf_dir), SEED), SEED)
    p = A.parse_actions(comp, "text", strict)
    return p.select("pipeline_id", "fault_step_id", "blame_role", "fix_content", "action_type", "parse_path")


def q_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4, strict variant."""
    return _parsed(spark, sf_dir, True)


def q_parse_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4, lenient variant."""
    return _parsed(spark, sf_dir, False)


def q_completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 on chat-form completions (some empty lists, some without content)."""
    comp = B.drawn_completions(B.drawn_actions(_bank(spark, sf_dir), SEED), SEED)
    msgs = B.completion_messages(comp, SEED)
    return msgs.select("pipeline_id", A.completion_text(F.col("messages")).alias("text"))


RUNS = 4


def _run_completions(spark, sf_dir) -> DataFrame:
    """Parsed B6 completions of ``RUNS`` runs, in bank order."""
    comp = B.drawn_completions(B.drawn_actions(_bank(spark, sf_dir), SEED), SEED)
    comp = comp.select(F.col("bank_pos").alias("completion_no"), "text", F.pmod("bank_pos", F.lit(RUNS)).alias("run_id"))
    return A.parse_actions(comp, "text", strict=True)


def q_score_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 chain at a frozen level: completion text -> strict parse -> cyclic
    episode of level 1 (X6) -> training reward at that level -> reward-log rows (P8)."""
    parsed, truth = _run_completions(spark, sf_dir).withColumn("level", F.lit(1)), B.lineitem_truth_numbers(spark, sf_dir, SEED)

    def score(share: DataFrame) -> DataFrame:
        met = X.assign_episodes(share, truth, level=1, pool=pool)  # texts are formed of the episodes met
        return P.reward_rows(R.score_total(B.truth_texts(met, SEED), "train", level_col="level"))

    with passing(spark):  # a share of the answers' texts is shuffled at a time, then of the runs' rewards
        pool = X._pool(truth, 1)  # numbered once for all shares
        scored = materialize_shares(parsed, "scored", "completion_no", score, passes=True, n=4)
        return materialize_shares(scored, "rewards", "run_id", lambda share: P.number_rewards(share, "run_id", ["completion_no"]))


def q_score_completions_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 chain with feedback: the run's level is re-read every 20 rewards."""
    return score_with_curriculum(_run_completions(spark, sf_dir), B.lineitem_truth_numbers(spark, sf_dir, SEED), w=30, check_every=20,
                                 thresholds=(0.2, 0.25), finish=lambda met: B.truth_texts(met, SEED))


# ---------------------------------------------------------------------------
# Negotiation
# ---------------------------------------------------------------------------


def q_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1/N2 on B5 attempt logs."""
    bank = _truth(spark, sf_dir)
    return N.replay(B.drawn_attempts(bank, SEED), bank)


def q_replay_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts after the terminal one too, flagged, stored."""
    bank = _truth(spark, sf_dir)
    return materialize(N.replay_all(B.drawn_attempts(bank, SEED), bank), "replayed")


def q_attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-episode attempt counts, final reward and history."""
    bank = _truth(spark, sf_dir)
    att = B.drawn_attempts(bank, SEED)
    h = N.attempt_history(att, N.replay(att, bank))
    entry = lambda x: F.concat_ws(":", x["attempt_no"].cast("string"), x["turn"].cast("string"), x["action_type"], x["accepted"].cast("string"))
    return h.select("episode_id", "step_count", "effective_attempts", "ignored_attempts", "final_reward",
                    F.array_join(F.transform("history", entry), ",").alias("history"))


# ---------------------------------------------------------------------------
# Sampling
# ---------------------------------------------------------------------------


def q_sample_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn episode per level."""
    return X.sample_one(_bank(spark, sf_dir), "curriculum_level", SEED).select("curriculum_level", "pipeline_id")


def q_head_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 100 episodes per level in bank order (the limit is the feature)."""
    return X.head_per_group(_bank(spark, sf_dir), "curriculum_level", 100).select("curriculum_level", "pipeline_id",
                                                                                  "bank_pos")


def q_sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as the bank has rows, from level 2."""
    bank = _bank(spark, sf_dir)
    return X.sample_with_replacement(bank, 2, bank.count(), SEED, keys_only=True).select("draw_no", "level_idx", "pipeline_id")


def q_sample_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as the bank has, cycling through level 3."""
    bank = _bank(spark, sf_dir)
    return X.sample_cyclic(bank, 3, bank.count(), keys_only=True).select("draw_no", "level_idx", "pipeline_id")


def q_assign_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions numbered by bank position cycle through level 3."""
    bank = _bank(spark, sf_dir)
    comp = bank.select(F.col("bank_pos").alias("completion_no"))
    return X.assign_episodes(comp, bank, level=3, offset=7, keys_only=True).select("completion_no", "level_idx", "pipeline_id")


def q_level_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: level 3 of the conversation bank, and level 4 (empty -> whole bank)."""
    bank = B.conversation_bank(spark, sf_dir, SEED)
    a = X.level_or_all(bank, 3).select(F.lit(3).alias("requested"), "pipeline_id")
    b = X.level_or_all(bank, 4).select(F.lit(4).alias("requested"), "pipeline_id")
    return a.unionByName(b)


def q_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11 + X4 + G13 on the lineitem bank."""
    return grade(_truth(spark, sf_dir))


def q_grade_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11's default rows: a bank whose filter keeps nothing."""
    return grade(_bank(spark, sf_dir).where("curriculum_level > 3"))


def q_baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 100 per level -> baseline actions -> training reward -> mean
    per level."""
    head = X.head_per_group(_truth(spark, sf_dir), "curriculum_level", 100)
    act = X.baseline_actions(head, SEED, K.BASELINE_FIX_OFFLINE, tag="offline")
    s = R.score_total(act, "train").withColumnRenamed("curriculum_level", "level")
    return G.mean_by_level(s, "level", ["total"])


# ---------------------------------------------------------------------------
# Audits
# ---------------------------------------------------------------------------


def q_bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bank_stats(_bank(spark, sf_dir))


def q_step_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _both(spark, sf_dir)
    return G.step_uniformity(bank)


def q_step_uniformity_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _both(spark, sf_dir)
    return G.step_uniformity(bank, include_zero=True)


def q_role_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.role_share(_bank(spark, sf_dir))


def q_error_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.error_mix(_bank(spark, sf_dir))


def q_keyword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keyword_quality(B.planted_bank(_both(spark, sf_dir), SEED))


def q_noop_corruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.noop_corruptions(_both(spark, sf_dir))


def q_constant_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.constant_guess_rate(_bank(spark, sf_dir))


def q_audit_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit_bank(_bank(spark, sf_dir))


# ---------------------------------------------------------------------------
# Reward-log analytics
# ---------------------------------------------------------------------------


def _log(spark, sf_dir):
    return B.events_reward_log(spark, sf_dir, 8, SEED)


def q_reward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7 itself (dense step numbers per run without a one-task window)."""
    return _log(spark, sf_dir)


def q_mean_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mean_by_level(_log(spark, sf_dir), "level", ["r_total", "r_loc", "r_fix"])


def q_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with w = 100 (environment window)."""
    return W.trailing_mean(_log(spark, sf_dir), 100)


def q_rolling_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and the four components, policy c."""
    return W.rolling_curve(_log(spark, sf_dir), ["r_total", "r_loc", "r_blame", "r_fix", "r_prec"], "c")


def q_rolling_curve_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rolling_curve(_log(spark, sf_dir), ["r_total"], "a")


def q_rolling_curve_interim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rolling_curve(_log(spark, sf_dir), ["r_total"], "interim")


def q_rolling_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rolling_accuracy(_log(spark, sf_dir), "b")


def q_curriculum_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 as the environment checks it: w = 100, every reward."""
    return W.curriculum(_log(spark, sf_dir), w=100, check_every=1)


def q_curriculum_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 as the trainers check it: w = 30, every 20 rewards."""
    return W.curriculum(_log(spark, sf_dir), w=30, check_every=20)


def q_curriculum_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 at batch ends of four: w = 50."""
    return W.curriculum(_log(spark, sf_dir), w=50, check_every=4)


def q_final_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.final_mean(_log(spark, sf_dir), 50)


def q_best_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_mean(_log(spark, sf_dir), 50)


def q_best_mean_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_mean(_log(spark, sf_dir), 50, include_last=True)


def q_early_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.early_late(_log(spark, sf_dir), "floor_ceil")


def q_early_late_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.early_late(_log(spark, sf_dir), "floor_floor")


def q_early_late_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.early_late_by_level(_log(spark, sf_dir))


def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_status(_log(spark, sf_dir), planned_total=2000)


def _tasks(spark, sf_dir) -> DataFrame:
    """Tasks of at most 10 steps (the evaluation loop's cap) cut from each run of
    the reward log; one in eight fails at a drawn step."""
    log = _log(spark, sf_dir)
    task = F.concat(F.lit("run"), F.col("run_id").cast("string"), F.lit("_"), F.floor((F.col("step") - 1) / 10).cast("string"))
    step_no = F.pmod(F.col("step") - 1, F.lit(10)) + 1
    fails = (B.draw(SEED, F.col("task"), "fail", n=8) == 0) & (F.col("step_no") == B.draw(SEED, F.col("task"), "failat", n=3) + 1)
    return log.select(task.alias("task"), step_no.alias("step_no"), "predicted_step", "predicted_role", F.col("r_total").alias("reward")).withColumn(
        "error", F.when(fails, F.concat(F.lit("model gave no answer at step "), F.col("step_no").cast("string")))
    )


def q_task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 over ``_tasks``."""
    return G.task_score(_tasks(spark, sf_dir), error_col="error")


# ---------------------------------------------------------------------------
# Projections
# ---------------------------------------------------------------------------


def q_observation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent view (no truth columns) of the lineitem bank."""
    o = P.observation_view(_bank(spark, sf_dir))
    return o.select("pipeline_id", "task_brief", "turn", "gatekeeper_feedback", "curriculum_level",
                    P.render_steps(F.col("pipeline")).alias("pipeline_text"))


def q_truth_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.truth_view(_bank(spark, sf_dir))
    return t.select("pipeline_id", "curriculum_level", "n_steps", "injected_step", "injected_role", "error_type",
                    "error_description", "original_output", "corrupted_output",
                    F.array_join("expected_fix_keywords", "|").alias("keywords"),
                    P.render_steps(F.col("clean_pipeline")).alias("clean_text"))


def q_explode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 inverse: one row per corrupted step."""
    return P.explode_steps(_bank(spark, sf_dir), "corrupted_pipeline", ("pipeline_id",))


def q_render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, both wordings."""
    return _bank(spark, sf_dir).select("pipeline_id", P.prompt_column("lenient").alias("prompt_lenient"),
                                       P.prompt_column("compact").alias("prompt_compact"))


def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages per episode (roles and contents flattened)."""
    m = P.to_messages(_bank(spark, sf_dir), "compact")
    return m.select(
        "pipeline_id",
        F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
        F.col("messages")[0]["content"].alias("system"),
        F.col("messages")[1]["content"].alias("user"),
    )


# ---------------------------------------------------------------------------
# Evaluation logs
# ---------------------------------------------------------------------------


def q_eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[START]/[STEP]/[END] lines per task of ``_tasks``."""
    return E.format_eval_log(_tasks(spark, sf_dir), model="baseline_random", error_col="error")


def q_parse_eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The STEP lines of S5 parsed back into per-step rows."""
    return E.parse_eval_log(q_eval_log(spark, sf_dir)).drop("line")


def q_parse_eval_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The END lines of S5, as task rows."""
    ends = E.parse_eval_ends(q_eval_log(spark, sf_dir))
    return ends.withColumn("rewards", F.array_join(F.transform("rewards", lambda x: F.format_string("%.4f", x)), ","))


def q_eval_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5/S6 through files: written as text, read line by line, END lines parsed."""
    path = scratch_path(spark, "evallog")
    E.write_eval_log(q_eval_log(spark, sf_dir), path)
    ends = E.parse_eval_ends(E.read_eval_log(spark, path), group_col="source")
    return ends.select("task", "success", "steps", "score", "error")


# ---------------------------------------------------------------------------
# Round trips: banks, reward logs, client payloads
# ---------------------------------------------------------------------------


def q_bank_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem bank written as JSON lines and read back, by shares of the
    traces: a share's file goes when its rows are read. What was read is stored packed, in pages
    that hold many traces, as an episode's texts are mostly those of the one before."""

    def through_json(bank: DataFrame) -> DataFrame:
        path = scratch_path(spark, "bank-json")
        io.write_bank(bank.select(*[f.name for f in io.EPISODE.fields]), path, fmt="json", compression="gzip")
        return io.pack_bank(io.read_bank(spark, path, fmt="json", multiline=False).drop("bank_pos"))

    trace = F.floor(F.col("bank_pos") / I.PER_TRACE)
    stored = materialize_shares(_bank(spark, sf_dir), "bank-read", trace, through_json, n=16, parquet_page_size=str(8 << 20), parquet_compression_codec_zstd_level="9")
    return bank_columns(io.with_bank_pos(io.unpack_bank(stored)))


def q_bank_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as Parquet by level, one level read back."""
    path = scratch_path(spark, "bank-level")
    io.write_bank(_bank(spark, sf_dir), path, partition_by_level=True, compression="zstd")
    return bank_columns(io.read_bank(spark, path, fmt="parquet").where("curriculum_level = 2"))


LOG_LAYOUTS = (
    ["step", "level", "pipeline_id", "r_loc", "r_blame", "r_fix", "r_prec", "r_total"],
    ["step", "level", "r_loc", "r_blame", "r_fix", "r_prec", "r_total", "predicted_step", "true_step", "predicted_role", "true_role"],
    ["step", "level", "pipeline_id", "r_loc", "r_blame", "r_fix", "r_prec", "r_total", "predicted_step", "true_step", "predicted_role", "true_role"],
)


def q_reward_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 -> G14: each run written as CSV in one of the three layouts, none of which
    has a run id, then read as one log and summed up per run."""
    log = _log(spark, sf_dir)
    paths = []
    for run in range(8):
        paths.append(scratch_path(spark, f"log-{run}"))
        io.write_log(log.where(F.col("run_id") == run).select(*LOG_LAYOUTS[run % 3]), paths[-1])
    return G.run_status(io.read_log(spark, *paths, run_ids=range(8)), planned_total=2000)


def q_encode_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action payloads."""
    return A.encode_action(B.drawn_actions(_bank(spark, sf_dir), SEED)).select("pipeline_id", "payload")


def q_decode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-result and state payloads built from observations, with keys left
    out at random, decoded with their defaults."""
    bank = _bank(spark, sf_dir)
    pid = F.col("pipeline_id")
    some = lambda c, tag: F.when(B.draw(SEED, pid, tag, n=3) > 0, c)  # noqa: E731  a null key is not written
    obs = F.struct(
        F.col("corrupted_pipeline").alias("pipeline"), some(F.col("task_brief"), "nobrief").alias("task_brief"),
        some(F.lit(2), "noturn").alias("turn"), some(F.col("curriculum_level"), "nolevel").alias("curriculum_level"), "pipeline_id",
    )
    payload = F.to_json(F.struct(obs.alias("observation"), F.lit(0.25).alias("reward"), some(F.lit(True), "nodone").alias("done")))
    state = F.to_json(F.struct(pid.alias("episode_id"), some(F.col("injected_step"), "nocount").alias("step_count")))
    got = bank.select("pipeline_id", A.decode_result(payload).alias("r"), A.decode_state(state).alias("s"))
    return got.select(
        "pipeline_id", P.render_steps(F.col("r.pipeline")).alias("pipeline_text"), F.col("r.task_brief").alias("task_brief"),
        F.col("r.turn").alias("turn"), F.col("r.gatekeeper_feedback").alias("gatekeeper_feedback"),
        F.col("r.curriculum_level").alias("curriculum_level"), F.col("r.done").alias("done"), F.col("r.reward").alias("reward"),
        F.col("s.episode_id").alias("episode_id"), F.col("s.step_count").alias("step_count"), F.col("s.metadata").alias("metadata"),
    )


# ---------------------------------------------------------------------------
# Streams, run to the end of their source into Parquet
# ---------------------------------------------------------------------------


def _stream(df: DataFrame, name: str) -> DataFrame:
    """A file stream over a stored copy of ``df``."""
    path = scratch_path(df.sparkSession, f"source-{name}")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _drained(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    return run_to_parquet(df, scratch_path(spark, f"sink-{name}"), scratch_path(spark, f"progress-{name}"))


def q_score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions stream joined to the static truth."""
    bank = _truth(spark, sf_dir)
    answers = _stream(B.drawn_completions(B.drawn_actions(bank, SEED), SEED).select("pipeline_id", "text"), "answers")
    scored = score_stream(answers, P.truth_view(bank), strict=True, variant="train")
    return _drained(scored.select("pipeline_id", "fault_step_id", "blame_role", *SCORE_COLS), "scores")


def q_curriculum_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every reward row, and a snapshot flag every 50 rewards."""
    log = _log(spark, sf_dir).select("run_id", "step", "r_total")
    return _drained(curriculum_stream(_stream(log, "rewards"), w=100, check_every=1, snapshot_every=50, group=4), "levels")


def q_replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as a stream, by batch jobs over the episodes' state."""
    bank = _truth(spark, sf_dir)
    return ReplayBatches(scratch_path(spark, "replay"), bank).run(_stream(B.drawn_attempts(bank, SEED), "attempts"))


TRUTH_DELAYS = (-1800, 600, 3600, 7200)  # seconds after the answer; a fifth draw never comes
ANSWERS_FROM = 1_700_000_000
SCORED_TRUTH = ("curriculum_level", "injected_step", "injected_role", "original_output", "corrupted_output", "expected_fix_keywords")


def _answers_and_truth(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """B6 completions with a time, and the truth of most of them, known before, soon
    after, just in time or too late. One last row on either side, far ahead, lets
    the watermark pass all others."""
    bank = _bank(spark, sf_dir)
    at = F.timestamp_seconds(F.col("bank_pos") + ANSWERS_FROM)
    comp = B.drawn_completions(B.drawn_actions(bank, SEED), SEED).select("pipeline_id", "text", at.alias("answered_at"))
    last = F.timestamp_seconds(F.lit(4_000_000_000))
    end = spark.range(1)
    answers = comp.unionByName(end.select(F.lit(None).cast("string").alias("pipeline_id"), F.lit(None).cast("string").alias("text"), last.alias("answered_at")))
    delay = F.element_at(F.array(*[F.lit(d) for d in (*TRUTH_DELAYS, None)]), (B.draw(SEED, F.col("pipeline_id"), "truthdelay", n=5) + 1).cast("int"))
    known = F.timestamp_seconds(F.col("bank_pos") + ANSWERS_FROM + delay)
    timed = bank.withColumn("known_at", known).where("known_at IS NOT NULL")
    truth = timed.select("pipeline_id", "known_at", *[c for c in SCORED_TRUTH])
    # a join drops truths without an id before their times are seen, so the last one has an id of its own
    return answers, truth.unionByName(end.select(F.lit("").alias("pipeline_id"), last.alias("known_at")), allowMissingColumns=True)


def q_score_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, both sides streams: answers score when their truth comes within an hour."""
    answers, truth = _answers_and_truth(spark, sf_dir)
    scored = score_as_truth_comes(_stream(answers, "answers"), _stream(truth, "truth"), patience="1 hour")
    rows = scored.select("pipeline_id", "fault_step_id", "blame_role", "scored", *SCORE_COLS)
    with state_in_zstd(spark):
        return _drained(rows, "late-scores").where("pipeline_id IS NOT NULL")


def q_curriculum_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2/T4 by batch jobs over a small state: the rows of ``curriculum_stream``."""
    log = _log(spark, sf_dir).select("run_id", "step", "r_total")
    batches = CurriculumBatches(scratch_path(spark, "curriculum-batches"), w=100, check_every=1, snapshot_every=50, group=4)
    return batches.run(_stream(log, "rewards"))


def _grown(spark: SparkSession, sf_dir: str, cols: list[str], widths: list[int]) -> CurveStore:
    """The log stored in two appends, the second with the last hundredth of each run."""
    log = _log(spark, sf_dir)
    correct = F.when(F.col("predicted_step") == F.col("true_step"), 1.0).otherwise(0.0)
    log = W.with_run_size(log.withColumn("correct", correct))
    old = F.col("step") <= F.col("n") - F.floor(F.col("n") / 100)
    kind = log.schema["run_id"].dataType.simpleString()
    store = CurveStore(spark, scratch_path(spark, "curves"), cols, widths, run_type=kind, level_width=widths[-1])
    store.append(log.where(old))
    store.append(log.where(~old))
    return store


def q_rolling_curve_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2/W3 of a log that grew: the rows of ``rolling_curve``."""
    cols = ["r_total", "r_loc", "r_blame", "r_fix", "r_prec"]
    return _grown(spark, sf_dir, cols, [50]).rolling_curve(cols, "c")


def q_curriculum_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 of a log that grew: the rows of ``curriculum_env``."""
    return _grown(spark, sf_dir, ["r_total"], [100]).curriculum()


def q_early_late_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8/W9 of a log that grew, from bucket sums: the rows of ``early_late``."""
    return _grown(spark, sf_dir, ["r_total", "correct"], [50]).early_late()


def q_replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 by event time: an attempt a minute, state dropped after an idle hour."""
    bank = _truth(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(ANSWERS_FROM) + F.col("attempt_no") * 60)
    attempts = _stream(B.drawn_attempts(bank, SEED).withColumn("at", at), "attempts")
    return ReplayBatches(scratch_path(spark, "replay-events"), bank, idle="1 hour").run(attempts)


REGISTRY = {
    "bank_lineitem": q_bank_lineitem,
    "bank_conversations": q_bank_conversations,
    "bank_of_tables": q_bank_of_tables,
    "flagship": q_flagship,
    "score_server": _score_query("server"),
    "score_train": _score_query("train"),
    "score_grade": _score_query("grade"),
    "score_infer": _score_query("infer"),
    "fix_components": q_fix_components,
    "verify_fix": q_verify_fix,
    "verify_documents": q_verify_documents,
    "gate": q_gate,
    "validate_actions": q_validate_actions,
    "validate_observations": q_validate_observations,
    "validate_bank": q_validate_bank,
    "parse_strict": q_parse_strict,
    "parse_lenient": q_parse_lenient,
    "completion_text": q_completion_text,
    "score_completions": q_score_completions,
    "replay": q_replay,
    "attempt_history": q_attempt_history,
    "sample_one": q_sample_one,
    "head_per_level": q_head_per_level,
    "sample_with_replacement": q_sample_with_replacement,
    "sample_cyclic": q_sample_cyclic,
    "level_or_all": q_level_or_all,
    "grade": q_grade,
    "baseline_report": q_baseline_report,
    "bank_stats": q_bank_stats,
    "step_uniformity": q_step_uniformity,
    "step_uniformity_zero": q_step_uniformity_zero,
    "role_share": q_role_share,
    "error_mix": q_error_mix,
    "keyword_quality": q_keyword_quality,
    "noop_corruptions": q_noop_corruptions,
    "constant_guess": q_constant_guess,
    "audit_bank": q_audit_bank,
    "reward_log": q_reward_log,
    "mean_by_level": q_mean_by_level,
    "trailing_mean": q_trailing_mean,
    "rolling_curve": q_rolling_curve,
    "rolling_curve_interim": q_rolling_curve_interim,
    "rolling_accuracy": q_rolling_accuracy,
    "curriculum_env": q_curriculum_env,
    "curriculum_trainer": q_curriculum_trainer,
    "final_mean": q_final_mean,
    "best_mean": q_best_mean,
    "early_late": q_early_late,
    "early_late_floor": q_early_late_floor,
    "early_late_by_level": q_early_late_by_level,
    "run_status": q_run_status,
    "task_score": q_task_score,
    "observation_view": q_observation_view,
    "truth_view": q_truth_view,
    "explode_steps": q_explode_steps,
    "render_prompt": q_render_prompt,
    "messages": q_messages,
    "eval_log": q_eval_log,
    "parse_eval_log": q_parse_eval_log,
    "score_completions_curriculum": q_score_completions_curriculum,
    "replay_all": q_replay_all,
    "assign_episodes": q_assign_episodes,
    "grade_empty": q_grade_empty,
    "rolling_curve_a": q_rolling_curve_a,
    "curriculum_batch": q_curriculum_batch,
    "best_mean_last": q_best_mean_last,
    "parse_eval_ends": q_parse_eval_ends,
    "eval_log_files": q_eval_log_files,
    "bank_json": q_bank_json,
    "bank_level": q_bank_level,
    "reward_log_files": q_reward_log_files,
    "encode_actions": q_encode_actions,
    "decode_results": q_decode_results,
    "score_stream": q_score_stream,
    "curriculum_stream": q_curriculum_stream,
    "replay_stream": q_replay_stream,
    "score_stream_late": q_score_stream_late,
    "curriculum_batches": q_curriculum_batches,
    "replay_events": q_replay_events,
    "rolling_curve_appended": q_rolling_curve_appended,
    "curriculum_appended": q_curriculum_appended,
    "early_late_appended": q_early_late_appended,
}

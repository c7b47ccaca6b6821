"""Plans and algorithms that must hold at any size: hot episodes, pruned rescoring,
the bucketed bank."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from faultlens.operators import negotiate as N
from faultlens.operators.training import chunk_of, chunk_start, score_with_curriculum
from faultlens.plans import bindings as B
from faultlens.plans import queries as Q


# --- N2: a hot episode ------------------------------------------------------


def attempts(spark, bank, n, hot):
    """Drawn attempts, ``hot`` of them of one episode; fixes pass or fail the gate."""
    rng = random.Random(5)
    truth = [r.asDict() for r in bank.select("pipeline_id", "injected_step", "injected_role", "original_output", "corrupted_output", "n_steps").limit(60).collect()]
    rows = []
    for i in range(n):
        t = truth[0] if i < hot else rng.choice(truth[1:])
        fix = rng.choice([t["original_output"], t["corrupted_output"], " ", "the correct type in the proper format"])
        rows.append((t["pipeline_id"], i + 1, rng.randint(0, 4), rng.choice(["Researcher", "Coder", "Nobody"]), fix, rng.choice(["propose", "revise", "submit"])))
    return spark.createDataFrame(rows, "episode_id string, attempt_no int, fault_step_id long, blame_role string, fix_content string, action_type string")


def walk(scored):
    """The replay of one episode, attempt by attempt."""
    told, acc, fb, n, out = False, False, None, 0, []
    terminal = None
    for r in sorted(scored, key=lambda r: r.attempt_no):
        n += 1
        if r.gated:
            acc = r.accepted
        turn = 2 if told else 1
        if r.gated and not r.accepted and not told:
            told, fb = True, r.feedback
            out.append((r.attempt_no, 1, False, fb, False, 0.0, n))
            continue
        total = (r.total_1 if turn == 1 else r.total_2) if acc else r.total_0
        out.append((r.attempt_no, turn, bool(r.gated and r.accepted), fb, True, total, n))
    terminal = 2 if out and not out[0][4] else 1
    return [(*x[:6], x[6] > terminal) for x in out]


@pytest.mark.parametrize("ranges", [1, 7])
def test_replay_of_a_hot_episode(spark, ranges):
    bank = B.lineitem_bank(spark, SF_SMALL)
    att = attempts(spark, bank, 900, 400)
    by_episode = {}
    for r in N.scored_attempts(att, bank).collect():
        by_episode.setdefault(r.episode_id, []).append(r)
    want = sorted((e, *x) for e, rows in by_episode.items() for x in walk(rows))
    got = N.replay_all(att, bank, n_ranges=ranges)
    columns = ["episode_id", "attempt_no", "turn", "accepted", "feedback", "done", "reward", "ignored"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
    first = N.replay(att, bank).select(*columns[:-1])
    assert sorted(map(repr, first.collect())) == sorted(map(repr, got.where("NOT ignored").select(*columns[:-1]).collect()))


def test_a_hot_episode_is_dealt_over_tasks(spark):
    from faultlens.plans.dense import ranged

    att = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("episode_id"), F.col("id").alias("attempt_no"))
    shares = ranged(att, ["episode_id", "attempt_no"], 12).groupBy("_rp", "episode_id").count().where("episode_id = 'hot'").collect()
    assert len(shares) >= 4 and max(r["count"] for r in shares) < 5_000  # of 10,000
    plan = Q.REGISTRY["replay_all"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(episode_id#\d+, \d+\).*\n.*fix_content", plan)


# --- E3: pruned rescoring ---------------------------------------------------


def test_chunks_cover_all_steps(spark):
    steps = spark.range(1, 3000).select(F.col("id").alias("step")).withColumn("c", chunk_of(F.col("step"), 16, 3)).collect()
    starts = {}
    for r in steps:
        starts.setdefault(r.c, r.step)
    assert list(starts.values()) == [chunk_start(c, 16, 3) for c in starts] and list(starts) == list(range(len(starts)))
    assert [b - a for a, b in zip(list(starts.values()), list(starts.values())[1:])][:5] == [16, 32, 64, 128, 128]


@pytest.mark.parametrize("thresholds", [(0.2, 0.25)])
def test_rows_are_scored_once_and_a_chunk_a_switch(spark, thresholds):
    comp, bank = Q._run_completions(spark, SF_SMALL), Q._bank(spark, SF_SMALL)
    key = lambda df: sorted(map(repr, df.collect()))
    passes = []
    kwargs = dict(w=30, check_every=20, thresholds=thresholds)
    got = score_with_curriculum(comp, bank, lookahead=256, most=512, passes=passes, **kwargs)
    whole = score_with_curriculum(comp, bank, lookahead=1 << 20, most=1 << 20, **kwargs)
    assert key(got) == key(whole)
    n = comp.count()
    switches = got.groupBy("run_id").agg(F.countDistinct("level").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    assert n <= sum(passes) <= n + switches * 512
    assert switches > 0


def test_no_completions(spark):
    comp = Q._run_completions(spark, SF_SMALL).limit(0)
    assert score_with_curriculum(comp, Q._bank(spark, SF_SMALL)).count() == 0


# --- the bucketed bank ------------------------------------------------------


@pytest.mark.parametrize("name", ["score_server", "score_train", "score_grade", "gate", "replay"])
def test_the_bank_meets_answers_without_an_exchange(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a bank too large to send
    try:
        plan = Q.REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and plan.count("FileScan parquet") == 2


def test_stored_columns_equal_their_definition(spark):
    from faultlens.operators.score import distinct_words

    bank = B.lineitem_bank(spark, SF_MID)
    wrong = bank.where((F.col("n_steps") != F.size("corrupted_pipeline")) | ~F.col("original_words").eqNullSafe(distinct_words(F.col("original_output"))))
    assert wrong.count() == 0 and bank.where("n_steps is null").count() == 0


def test_the_bank_is_stored_as_numbers_and_its_sources_go(spark):
    import os

    from faultlens.plans.materialize import materialize, passing
    from faultlens.session import ensure_checkpoint_dir

    bank = B.lineitem_bank(spark, SF_SMALL, seed=4711)
    plan = bank.select("clean_pipeline", "corrupted_pipeline", "original_output")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "lines:" in schema and "clean_pipeline" not in schema and "original_output" not in schema
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("faultlens-lines-")]
    with passing(spark) as made:
        path = materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file:")
        assert len(made) == 1 and os.path.exists(path)
    assert not os.path.exists(path)
    whole = B.lineitem_bank(spark, SF_SMALL, seed=4711, materialized=False)
    cols = [c for c in whole.columns]
    assert sorted(map(repr, bank.select(cols).collect())) == sorted(map(repr, whole.select(cols).collect()))


def test_a_trace_is_stored_once_and_answers_meet_two_of_its_lines(spark):
    from faultlens.plans import materialize as M

    bank, truth = B.lineitem_bank(spark, SF_SMALL, seed=4712), B.lineitem_truth(spark, SF_SMALL, seed=4712)
    stored = {k[1]: df for k, df in M._KEPT.items() if k[-1] == 4712}
    assert stored["bank-li"].count() == bank.select("clean_pipeline", "task_brief", F.floor(F.col("bank_pos") / 5)).distinct().count() < bank.count()
    assert "lines" not in stored["truth-li"].columns and "corrupted_output" not in stored["bank-li"].columns + stored["truth-li"].columns
    cols = [c for c in truth.columns if c != "first_output"]
    key = lambda df: sorted(map(repr, df.collect()))
    assert set(bank.columns) - set(cols) == {"clean_pipeline", "corrupted_pipeline"}
    first = F.col("clean_pipeline")[0]["output"].alias("first_output")
    assert key(truth.select(*cols, "first_output")) == key(bank.select(*cols, first))
    assert key(B.drawn_attempts(truth)) == key(B.drawn_attempts(bank))


def test_lines_are_numbered_by_shares_of_the_orders(spark, monkeypatch):
    from faultlens.plans import dense

    orders = [None, None, None, *[7] * 400, *[k for k in range(60) for _ in range(k % 9)], -5]
    rows = [(o, i % 4, i % 11, i % 3, "2020-01-01", float(i % 5), float(i % 6)) for i, o in enumerate(orders)]  # equal lines too
    li = spark.createDataFrame(rows, ["l_orderkey", *B.LINE_ORDER]).repartition(5)
    want = B.lineitem_lines(B.lineitem_numbered(li))
    sizes, ranged = [], dense.ranged
    monkeypatch.setattr(dense, "ranged", lambda df, *a: sizes.append(df.count()) or ranged(df, *a))
    got = B.by_orders(li, "numbered", lambda traces: traces, bucket="trace_id")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got.select(*want.columns)) == key(want) and want.where("order is null").count() == 1
    assert sum(sizes) == len(rows) and len(sizes) > 2 and sorted(sizes)[-2] < len(rows) / 3  # but for the share of the large order


def test_answers_meet_the_bank_without_a_second_store(spark):
    from faultlens.operators.traces import truth_view

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.REGISTRY["fix_components"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and plan.count("faultlens_bank_li") >= 2 and "truth_li" not in plan
    truth = B.lineitem_truth(spark, SF_SMALL)
    want, got = B.drawn_actions(truth).join(truth_view(truth), "pipeline_id"), Q._acted(spark, SF_SMALL)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_traces_are_formed_once_for_their_steps(spark):
    plan = Q.REGISTRY["explode_steps"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "size(" not in plan
    empty = spark.createDataFrame([("a", [(1, "r", "t")]), ("b", []), ("c", None)], "pipeline_id string, corrupted_pipeline array<struct<step_id:int,role:string,output:string>>")
    from faultlens.operators.traces import explode_steps

    assert [tuple(r) for r in explode_steps(empty).collect()] == [("a", 1, "r", "t")]


def test_a_line_of_a_log_is_matched_once(spark):
    plan = Q.REGISTRY["parse_eval_log"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(_l#\d+, \^\\+\[STEP", plan)) == 1


def test_a_document_is_lowered_once(spark):
    plan = Q.REGISTRY["verify_documents"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\((?:coalesce\()?text", plan)) == 1


def test_answers_are_scored_and_replayed_by_shares(spark):
    from faultlens.operators import sampling as X
    from faultlens.operators import score as R
    from faultlens.operators import traces as P

    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    bank = Q._bank(spark, SF_SMALL)
    replayed, rewards = (Q.REGISTRY[q](spark, SF_SMALL) for q in ("replay_all", "score_completions"))
    for df in (replayed, rewards):  # what was shuffled for them is gone
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert key(replayed) == key(N.replay_all(B.drawn_attempts(bank), bank))
    parsed = Q._run_completions(spark, SF_SMALL).withColumn("level", F.lit(1))
    assert key(rewards) == key(P.to_reward_log(R.score_total(X.assign_episodes(parsed, bank, level=1), "train", level_col="level")))


@pytest.mark.parametrize("name", ["sample_cyclic", "sample_with_replacement", "assign_episodes"])
def test_sampled_keys_do_not_meet_the_bank_again(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Join Inner, \(pipeline_id#\d+ = pipeline_id", plan)


# --- time -------------------------------------------------------------------


def test_words_and_numbers_are_those_of_python(spark):
    from faultlens.functions import text as T

    spaces = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace()]
    texts = ["", " ", "a", "  one two\n", "\x1cx\x85y\u3000", "été\u00a0 12 a3 _4 5é 007", *[f"{c}a{c}{c}b {c}" for c in spaces]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = df.select("t", T.tokens("t").alias("w"), T.utrim("t").alias("s"), F.regexp_extract_all("t", F.lit(T.WHOLE_NUMBER), 0).alias("n")).collect()
    assert len(got) == len(texts) + 1 > 25 and set(T.SPACES) == set(spaces)
    for r in got:
        assert (r.w, r.s, r.n) == ((None,) * 3 if r.t is None else (r.t.split(), r.t.strip(), re.findall(r"\b\d+\b", r.t)))
    plan = df.select(T.tokens("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # its pattern is compiled for every row


def test_code_too_long_to_be_compiled_is_not_generated(spark):
    Q._bank(spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_steps_of_a_trace_are_formed_once_for_its_episodes(spark):
    plan = Q.REGISTRY["render_prompt"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    explode = plan.index("Generate explode")
    assert "transform(lines" not in plan[:explode] and plan.count("transform(lines") == 1


def test_parts_of_a_fix_are_scored_once(spark):
    plan = Q.REGISTRY["fix_components"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1


def test_lengths_are_counted_without_texts(spark):
    for name in ("step_uniformity", "step_uniformity_zero"):
        plan = Q.REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(lines" not in plan and "Score for supplier" not in plan


def test_fields_are_formed_once_for_their_checks(spark):
    from faultlens.operators import audit as G

    plan = Q.REGISTRY["validate_bank"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(lines") == 2  # the bank, and the episodes that come twice
    whole = {"pipeline_id": "a", "curriculum_level": 1, "task_brief": "t", "clean_pipeline": ["x"], "corrupted_pipeline": ["x"], "injected_step": 1, "injected_role": "r", "error_type": "e",
             "error_description": "d", "original_output": "o", "corrupted_output": "c", "expected_fix_keywords": ["k"]}
    rows = [whole, whole | {"pipeline_id": None, "error_type": None, "injected_role": None}, whole | {"pipeline_id": "b", "expected_fix_keywords": []}, whole | {"pipeline_id": "c", "expected_fix_keywords": None}]
    types = {"clean_pipeline": "array<string>", "corrupted_pipeline": "array<string>", "expected_fix_keywords": "array<string>", "curriculum_level": "int", "injected_step": "int"}
    bank = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {types.get(c, 'string')}" for c in whole))
    want = [("UNKNOWN", "missing fields: pipeline_id, injected_role, error_type"), ("b", "empty expected_fix_keywords"), ("c", "empty expected_fix_keywords"), ("c", "missing fields: expected_fix_keywords"),
            (None, "Duplicate IDs found: 4 episodes but 3 unique IDs")]
    assert sorted(map(tuple, G.validate_bank(bank).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [0, 20, 10_000])
def test_only_long_episodes_are_replayed_by_ranges(spark, most, monkeypatch):
    bank = B.lineitem_bank(spark, SF_SMALL)
    att = attempts(spark, bank, 900, 400)
    cut, ranged = [], N.ranged
    monkeypatch.setattr(N, "ranged", lambda df, *a: cut.append(df.select("episode_id").distinct().count()) or ranged(df, *a))
    key = lambda df: sorted(map(repr, df.collect()))
    got = key(N.replay_all(att, bank, most=most))
    n = att.select("episode_id").distinct().count()
    long = att.groupBy("episode_id").count().where(F.col("count") > most).count()
    assert cut == ([] if most == 10_000 else [long]) and (most != 20 or 0 < long < n)
    assert got == key(N.replay_all(att, bank, n_ranges=7)) and len(got) == 900


def test_answers_meet_numbers_and_texts_are_formed_of_what_was_met(spark, monkeypatch):
    from faultlens.operators import sampling as X

    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    numbers, comp = B.lineitem_truth_numbers(spark, SF_SMALL), Q._run_completions(spark, SF_SMALL)
    assert not {"original_output", "corrupted_output", "first_output", "expected_fix_keywords"} & set(numbers.columns)
    kwargs = dict(w=30, check_every=20, thresholds=(0.2, 0.25), lookahead=256, most=512)
    met = []
    got = score_with_curriculum(comp, numbers, **kwargs, finish=lambda df: met.append(df.columns) or B.truth_texts(df))
    assert key(got) == key(score_with_curriculum(comp, B.lineitem_truth(spark, SF_SMALL), **kwargs))
    assert met and all("terms" in c and "corrupted_output" not in c for c in met)
    pools, pool = [], X._pool
    monkeypatch.setattr(X, "_pool", lambda *a: pools.append(a[1]) or pool(*a))
    Q.REGISTRY["score_completions"](spark, SF_SMALL)
    assert pools == [1]  # not once a share

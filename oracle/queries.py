"""DuckDB oracle SQL per registered query (same column names as Spark)."""

from __future__ import annotations

from faultlens.functions import constants as K
from oracle import sql as S
from oracle.sql import D, q

BANK = [S.LI_STEPS, S.bank_ctes("li", "li")]


def W(*ctes: str) -> str:
    return S.with_(*BANK, *ctes)


def _score(variant: str) -> str:
    fix, o, kw, c = "fix_content", "original_output", "expected_fix_keywords", "corrupted_output"
    r1 = S.loc("fault_step_id", "injected_step", "curriculum_level")
    r2 = S.blame("blame_role", "injected_role")
    if variant == "server":
        rule = S.gate_rule("fault_step_id", "blame_role", fix, "n_steps", c, kw)
        acc = f"(action_type IN ('propose', 'revise') AND ({rule}) IS NULL)"
        r3, r4 = S.fix_score(fix, o, kw, c, True), S.precision("1", acc)
    elif variant == "train":
        r3, r4 = S.fix_score(fix, o, kw, c, False), D(0.2)
    elif variant == "grade":
        r3, r4 = S.fix_simple(fix, kw, 0.3, True), D(K.GRADER_PRECISION)
    else:
        r3, r4 = S.fix_simple(fix, kw, 0.0, False), D(K.INFERENCE_PRECISION)
    total = S.wtotal("localization", "blame", "fix", "precision")
    if variant in ("server", "infer"):
        total = S.round4(total)
    return W(S.LI_ACT, f"""sc AS (SELECT pipeline_id, {r1} AS localization, {r2} AS blame, {r3} AS fix, {r4} AS precision
                                 FROM li_acted)""") + f"\nSELECT pipeline_id, localization, blame, fix, precision, {total} AS total FROM sc"


def _verify(fix: str, kw: str, role: str) -> dict:
    low = f"lower({fix})"
    n = f"coalesce(len({kw}), 0)"

    def kwpart(w):
        return f"(CASE WHEN {n} > 0 THEN {D(w)} * (CAST({S.hits(fix, kw)} AS DOUBLE) / CAST({n} AS DOUBLE)) ELSE {D(0.0)} END)"

    def any_in(text, terms):
        return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"

    def count_in(text, terms):
        return "(" + " + ".join(f"(CASE WHEN contains({text}, {q(t)}) THEN 1 ELSE 0 END)" for t in terms) + ")"

    words = f"len({S.tokens(fix)})"
    res = (f"least({kwpart(0.6)} + (CASE WHEN {any_in(low, K.EXPLANATION_INDICATORS)} THEN {D(0.2)} ELSE {D(0.0)} END) + "
           f"(CASE WHEN {words} >= 10 AND {words} <= 200 THEN {D(0.2)} WHEN {words} > 5 THEN {D(0.1)} ELSE {D(0.0)} END), {D(1.0)})")
    lines = f"len(string_split({S.utrim(fix)}, chr(10)))"
    code = f"least(CAST({count_in(fix, K.CODE_INDICATORS)} AS DOUBLE) / {D(3.0)}, {D(1.0)})"
    cod = (f"least({kwpart(0.5)} + {D(0.3)} * {code} + (CASE WHEN {lines} >= 2 AND {lines} <= 50 THEN {D(0.2)} "
           f"WHEN {lines} = 1 AND length({fix}) > 20 THEN {D(0.1)} ELSE {D(0.0)} END), {D(1.0)})")
    has_num = f"regexp_matches({fix}, '[0-9]')"
    has_term = any_in(low, K.QUANT_TERMS)
    ana = (f"least({kwpart(0.5)} + (CASE WHEN {has_num} AND {has_term} THEN {D(0.3)} WHEN {has_num} OR {has_term} "
           f"THEN {D(0.15)} ELSE {D(0.0)} END) + (CASE WHEN {count_in(fix, K.REPORT_INDICATORS)} >= 2 THEN {D(0.2)} "
           f"ELSE {D(0.0)} END), {D(1.0)})")
    generic = f"(CASE WHEN {n} > 0 THEN CAST({S.hits(fix, kw)} AS DOUBLE) / CAST({n} AS DOUBLE) ELSE {D(0.0)} END)"
    routed = (f"(CASE WHEN {S.is_blank(fix)} THEN {D(0.0)} WHEN {role} = 'Researcher' THEN {res} WHEN {role} = 'Coder' "
              f"THEN {cod} WHEN {role} = 'Analyst' THEN {ana} ELSE {generic} END)")
    return {"researcher": res, "coder": cod, "analyst": ana, "routed": routed}


def _verify_fix() -> str:
    v = _verify("fix_content", "expected_fix_keywords", "blame_role")
    return W(S.LI_ACT) + (f"\nSELECT pipeline_id, {v['researcher']} AS researcher, {v['coder']} AS coder, "
                          f"{v['analyst']} AS analyst, {v['routed']} AS routed FROM li_acted")


def _logic_kw(t: str) -> str:
    found = f"list_filter({S.lst(K.LOGIC_TERMS)}, lambda x: contains(lower({t}), lower(x)))"
    return f"(CASE WHEN len({found}) > 0 THEN ({found})[1:{K.MAX_KEYWORDS}] ELSE {S.lst(K.KEYWORDS_LOGIC_DEFAULT)} END)"


def _verify_documents() -> str:
    role = S.elem(S.ROLES_BAD, "doc_id % 4")
    v = _verify("text", "kw", "role")
    return (f"WITH d AS (SELECT doc_id, text, {_logic_kw('text')} AS kw, {role} AS role FROM documents)\n"
            f"SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS n_words, {S.share('text', 'kw', 0.5)} AS keyword_share, "
            f"{v['researcher']} AS researcher, {v['coder']} AS coder, {v['analyst']} AS analyst, {v['routed']} AS routed "
            f"FROM d")


def _fix_components() -> str:
    fix, o, kw, c = "fix_content", "original_output", "expected_fix_keywords", "corrupted_output"
    return W(S.LI_ACT) + (
        f"\nSELECT pipeline_id, {S.share(fix, kw, 0.5)} AS keyword_share, {S.not_corrupt(fix, c)} AS not_corrupt, "
        f"{S.length_fit(fix, o)} AS length_fit, {S.word_overlap(fix, o)} AS word_overlap, "
        f"{S.fix_score(fix, o, kw, c, True)} AS fix_server, {S.fix_score(fix, o, kw, c, False)} AS fix_train, "
        f"{S.fix_simple(fix, kw, 0.3, True)} AS fix_grade, {S.fix_simple(fix, kw, 0.0, False)} AS fix_infer FROM li_acted")


def _gate() -> str:
    rule = S.gate_rule("fault_step_id", "blame_role", "fix_content", "n_steps", "corrupted_output", "expected_fix_keywords")
    fb = S.gate_feedback("violated_rule", "fault_step_id", "blame_role", "n_steps", "expected_fix_keywords")
    return W(S.LI_ACT, f"g AS (SELECT *, {rule} AS violated_rule FROM li_acted)") + (
        f"\nSELECT pipeline_id, violated_rule IS NULL AS accepted, violated_rule, {fb} AS feedback FROM g")


def _validate_actions() -> str:
    roles = ", ".join(q(r) for r in K.ROLES)
    types = ", ".join(q(t) for t in K.ACTION_TYPES)
    parts = [
        "CASE WHEN fault_step_id IS NULL OR fault_step_id < 1 OR fault_step_id > 6 THEN 'fault_step_id' END",
        f"CASE WHEN blame_role IS NULL OR blame_role NOT IN ({roles}) THEN 'blame_role' END",
        "CASE WHEN fix_content IS NULL OR length(fix_content) < 1 THEN 'fix_content' END",
        f"CASE WHEN action_type IS NULL OR action_type NOT IN ({types}) THEN 'action_type' END",
    ]
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return W(S.LI_ACT) + f"\nSELECT pipeline_id, array_to_string({arr}, ',') AS violations FROM li_act"


def _bank_of_tables() -> str:
    base = ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(K.FACTUAL_SWAPS))
    first = len(K.FACTUAL_SWAPS)
    digits = "6 * CAST(h.pos AS BIGINT)"
    md5s = " || ".join(f"md5(concat_ws(':', '42', h.pipeline_id, 'fact', CAST({digits} // 32 + {j} AS VARCHAR)))" for j in (0, 1))
    prio = f"CAST('0x' || substr({md5s}, {digits} % 32 + 1, 6) AS BIGINT) * 4294967296 + h.pos"
    at = "strpos(lower(e.original_output), lower(b.find))"
    return W(f"""tb AS (SELECT * FROM (VALUES {base}) t(pos, find, repl) UNION ALL
              SELECT row_number() OVER (ORDER BY p_partkey) + {first - 1}, 'part ' || CAST(p_partkey AS VARCHAR), 'part ' || CAST(p_partkey + 1 AS VARCHAR)
              FROM (SELECT DISTINCT p_partkey FROM part WHERE p_partkey IS NOT NULL)),
        fe AS (SELECT pipeline_id, original_output, lower(original_output) AS low FROM li_e3 WHERE error_type = 'factual_error'),
        h AS (SELECT fe.pipeline_id, tb.* FROM fe JOIN (SELECT *, lower(find) AS lowfind FROM tb) tb ON contains(fe.low, tb.lowfind)),
        best AS (SELECT h.pipeline_id, arg_min(struct_pack(find := h.find, repl := h.repl), {prio}) AS b,
                        list(h.find ORDER BY h.pos)[1:{K.MAX_KEYWORDS}] AS kw FROM h GROUP BY h.pipeline_id)""") + f"""
SELECT pipeline_id, error_type, corrupted_output, array_to_string(expected_fix_keywords, '|') AS keywords FROM li_bank WHERE error_type <> 'factual_error'
UNION ALL
SELECT e.pipeline_id, 'factual_error',
       CASE WHEN b.find IS NULL THEN e.original_output || {q(K.FACTUAL_FALLBACK)}
            ELSE substr(e.original_output, 1, {at} - 1) || b.repl || substr(e.original_output, {at} + length(b.find)) END,
       CASE WHEN b.find IS NULL THEN {q('|'.join(K.KEYWORDS_FACTUAL_DEFAULT))} ELSE array_to_string(kw, '|') END
FROM fe e LEFT JOIN best ON e.pipeline_id = best.pipeline_id"""


def _validate_observations() -> str:
    arr = ("list_filter([CASE WHEN turn IS NULL OR turn < 1 THEN 'turn' END, CASE WHEN curriculum_level IS NULL OR "
           "curriculum_level < 1 OR curriculum_level > 3 THEN 'curriculum_level' END], lambda x: x IS NOT NULL)")
    bad, n_att = S.draw("20", "pipeline_id", q("badlevel")), S.draw("3", "pipeline_id", q("n_att"))
    # neither ids, levels nor the number of attempts need any text
    ids = lambda src, prefix: (f"SELECT {q(prefix + '_')} || CAST(trace_id AS VARCHAR) || '_err_' || CAST(k AS VARCHAR) AS pipeline_id, "  # noqa: E731
                               f"curriculum_level FROM (SELECT DISTINCT trace_id, curriculum_level, unnest(range(0, 5)) AS k FROM {src}_steps)")
    return S.with_(S.LI_STEPS, S.CV_STEPS, f"""
ids AS ({ids('li', 'li')} UNION ALL {ids('cv', 'cv')}),
obs AS (SELECT pipeline_id AS episode_id, CAST(attempt_no AS INTEGER) AS attempt_no, CAST(attempt_no - 1 AS INTEGER) AS turn,
               CASE WHEN {bad} = 0 THEN 4 ELSE curriculum_level END AS curriculum_level
        FROM (SELECT *, unnest(range(1, CAST({n_att} + 2 AS BIGINT))) AS attempt_no FROM ids))""") + (
        f"\nSELECT episode_id, attempt_no, array_to_string({arr}, ',') AS violations FROM obs")


def _parse(strict: bool) -> str:
    p = S.parse_sql("text", strict)
    cols = ", ".join(f"{v} AS {k}" for k, v in p.items())
    return W(S.LI_ACT, S.LI_COMP) + f"\nSELECT pipeline_id, {cols} FROM li_comp"


def _completion_text() -> str:
    kind = S.draw("4", "pipeline_id", q("mform"))
    return W(S.LI_ACT, S.LI_COMP) + (
        f"\nSELECT pipeline_id, CASE {kind} WHEN 0 THEN text WHEN 1 THEN text ELSE '' END AS text FROM li_comp")


def _pool(level: int) -> str:
    """Level pool with a 0-based index in bank order (whole bank if empty)."""
    return f"""pool AS (
  SELECT *, row_number() OVER (ORDER BY bank_pos) - 1 AS level_idx FROM li_bank
  WHERE curriculum_level = {level} OR NOT EXISTS (SELECT 1 FROM li_bank WHERE curriculum_level = {level})
), pool_n AS (SELECT count(*) AS n FROM pool)"""


def _draws(level: int, expr: str) -> str:
    return W(_pool(level), f"dr AS (SELECT range AS draw_no, {expr} AS level_idx FROM range((SELECT count(*) FROM li_bank)))") + (
        "\nSELECT dr.draw_no, dr.level_idx, pool.pipeline_id FROM dr JOIN pool ON dr.level_idx = pool.level_idx")


def _sample_with_replacement() -> str:
    return _draws(2, S.draw("(SELECT n FROM pool_n)", "range", q("wr")))


def _assign_episodes() -> str:
    return W(_pool(3), "dr AS (SELECT bank_pos AS completion_no, (bank_pos + 7) % (SELECT n FROM pool_n) AS level_idx FROM li_bank)") + (
        "\nSELECT dr.completion_no, dr.level_idx, pool.pipeline_id FROM dr JOIN pool ON dr.level_idx = pool.level_idx")


def _sample_one() -> str:
    return W() + (" SELECT curriculum_level, arg_min(pipeline_id, md5(concat_ws(':', '42', 'one', pipeline_id)) || pipeline_id) "
                  "AS pipeline_id FROM li_bank GROUP BY curriculum_level")


def _head_per_level() -> str:
    return W() + (" SELECT curriculum_level, pipeline_id, bank_pos FROM (SELECT *, row_number() OVER (PARTITION BY "
                  "curriculum_level ORDER BY bank_pos) AS rn FROM li_bank) WHERE rn <= 100")


def _baseline(src: str, seed_sql: str, fix: str, tag: str) -> str:
    step = S.draw(f"greatest(len(corrupted_pipeline), 1)", "pipeline_id", q(tag + "_step"))
    role = S.elem(K.ROLES, S.draw("3", "pipeline_id", q(tag + "_role")))
    return (f"SELECT *, CAST({step} + 1 AS BIGINT) AS fault_step_id, {role} AS blame_role, {q(fix)} AS fix_content "
            f"FROM {src}")


def _flagship() -> str:
    fix, o, kw, c = "fix_content", "original_output", "expected_fix_keywords", "corrupted_output"
    sc = (f"SELECT curriculum_level AS level, {S.loc('fault_step_id', 'injected_step', 'curriculum_level')} AS localization, "
          f"{S.blame('blame_role', 'injected_role')} AS blame, {S.fix_score(fix, o, kw, c, False)} AS fix, {D(0.2)} AS precision "
          f"FROM act")
    return W(f"act AS ({_baseline('li_bank', '42', K.BASELINE_FIX_OFFLINE, 'base')})", f"sc AS ({sc})",
             f"tot AS (SELECT *, {S.wtotal('localization', 'blame', 'fix', 'precision')} AS total FROM sc)") + (
        f"\nSELECT level, CAST(count(*) AS BIGINT) AS n, {S.un_mean('total')} AS mean_total, "
        f"{S.un_mean('localization')} AS mean_localization, {S.un_mean('blame')} AS mean_blame, "
        f"{S.un_mean('fix')} AS mean_fix FROM tot GROUP BY level")


def _baseline_report() -> str:
    fix, o, kw, c = "fix_content", "original_output", "expected_fix_keywords", "corrupted_output"
    head = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_level ORDER BY bank_pos) AS rn "
            "FROM li_bank) WHERE rn <= 100")
    sc = (f"SELECT curriculum_level AS level, {S.loc('fault_step_id', 'injected_step', 'curriculum_level')} AS localization, "
          f"{S.blame('blame_role', 'injected_role')} AS blame, {S.fix_score(fix, o, kw, c, False)} AS fix, {D(0.2)} AS precision "
          f"FROM act")
    return W(f"head AS ({head})", f"act AS ({_baseline('head', '42', K.BASELINE_FIX_OFFLINE, 'offline')})", f"sc AS ({sc})",
             f"tot AS (SELECT *, {S.wtotal('localization', 'blame', 'fix', 'precision')} AS total FROM sc)") + (
        f"\nSELECT level, CAST(count(*) AS BIGINT) AS n, {S.un_mean('total')} AS mean_total FROM tot GROUP BY level")


def _grade() -> str:
    parts = []
    for level, seed in K.GRADER_SEEDS.items():
        pool = (f"SELECT *, row_number() OVER (ORDER BY bank_pos) - 1 AS level_idx FROM li_bank WHERE curriculum_level = {level} "
                f"OR NOT EXISTS (SELECT 1 FROM li_bank WHERE curriculum_level = {level})")
        pick = f"SELECT * FROM ({pool}) p WHERE level_idx = {seed} % (SELECT count(*) FROM ({pool}) z)"
        saved = S.SEED
        S.SEED = seed
        act = _baseline(f"({pick})", str(seed), K.BASELINE_FIX_GRADER, "grade")
        S.SEED = saved
        fixs = S.fix_simple("fix_content", "expected_fix_keywords", 0.3, True)
        sc = (f"SELECT {level} AS level, pipeline_id, {S.loc('fault_step_id', 'injected_step', str(level))} AS localization, "
              f"{S.blame('blame_role', 'injected_role')} AS blame, {fixs} AS fix, {D(K.GRADER_PRECISION)} AS precision "
              f"FROM ({act}) a")
        parts.append(sc)
    u = " UNION ALL ".join(parts)
    tgt = " UNION ALL ".join(f"SELECT {lv} AS level, {D(t)} AS target" for lv, t in K.TARGET_MEAN_BY_LEVEL.items())
    return W(f"u AS ({u})", f"tot AS (SELECT *, {S.wtotal('localization', 'blame', 'fix', 'precision')} AS total FROM u)",
             f"tg AS ({tgt})") + (
        "\nSELECT tot.level, pipeline_id, localization, blame, fix, precision, total, target, total > target AS meets_target "
        "FROM tot LEFT JOIN tg ON tot.level = tg.level")


ORACLES: dict[str, str] = {
    "bank_lineitem": S.bank_query("li"),
    "bank_conversations": S.bank_query("cv"),
    "flagship": _flagship(),
    "score_server": _score("server"),
    "score_train": _score("train"),
    "score_grade": _score("grade"),
    "score_infer": _score("infer"),
    "fix_components": _fix_components(),
    "verify_fix": _verify_fix(),
    "verify_documents": _verify_documents(),
    "gate": _gate(),
    "validate_actions": _validate_actions(),
    "parse_strict": _parse(True),
    "parse_lenient": _parse(False),
    "completion_text": _completion_text(),
    "sample_one": _sample_one(),
    "head_per_level": _head_per_level(),
    "sample_with_replacement": _sample_with_replacement(),
    "sample_cyclic": _draws(3, "range % (SELECT n FROM pool_n)"),
    "assign_episodes": _assign_episodes(),
    "grade": _grade(),
    "baseline_report": _baseline_report(),
}


# ---------------------------------------------------------------------------
# Batch 2: replay, audits, reward-log analytics, projections, eval logs
# ---------------------------------------------------------------------------

CV = [S.CV_STEPS, S.bank_ctes("cv", "cv")]
BOTH = "allbank AS (SELECT * FROM li_bank UNION ALL SELECT * FROM cv_bank)"


def WB(*ctes: str) -> str:
    return S.with_(*BANK, *CV, BOTH, *ctes)


def _replay_ctes() -> list[str]:
    kw, c = "expected_fix_keywords", "corrupted_output"
    rule = S.gate_rule("fault_step_id", "blame_role", "fix_content", "n_steps", c, kw)
    fb = S.gate_feedback("violated_rule", "fault_step_id", "blame_role", "n_steps", kw)
    gated = "action_type IN ('propose', 'revise')"
    return [
        S.LI_ATT,
        "f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY attempt_no) AS rn FROM li_att) WHERE rn <= 2)",
        f"""j AS (SELECT f2.*, b.curriculum_level, CAST(len(b.corrupted_pipeline) AS INTEGER) AS n_steps, b.injected_step,
                b.injected_role, b.original_output, b.corrupted_output, b.expected_fix_keywords
                FROM f2 JOIN li_bank b ON f2.episode_id = b.pipeline_id)""",
        f"g0 AS (SELECT *, {rule} AS violated_rule FROM j)",
        f"g1 AS (SELECT *, violated_rule IS NULL AS accepted, {fb} AS feedback FROM g0)",
        f"""g2 AS (SELECT *, (rn = 1 AND {gated} AND NOT accepted) AS rej1 FROM g1)""",
        """g3 AS (SELECT *, max(CASE WHEN rej1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id) = 1 AS t1r,
                max(CASE WHEN rej1 THEN feedback END) OVER (PARTITION BY episode_id) AS t1f FROM g2)""",
        f"""g4 AS (SELECT *, CAST(rn AS INTEGER) AS turn, NOT (rn = 1 AND t1r) AS done, ({gated} AND accepted) AS gacc
                FROM g3 WHERE rn = 1 OR t1r)""",
        f"""g5 AS (SELECT *, {S.loc('fault_step_id', 'injected_step', 'curriculum_level')} AS loc,
                {S.blame('blame_role', 'injected_role')} AS bl,
                {S.fix_score('fix_content', 'original_output', kw, c, True)} AS fx,
                {S.precision('turn', 'gacc')} AS pr FROM g4)""",
        f"g6 AS (SELECT *, {S.round4(S.wtotal('loc', 'bl', 'fx', 'pr'))} AS tot FROM g5)",
        f"""rep AS (SELECT episode_id, attempt_no, turn, action_type, gacc AS accepted,
                CASE WHEN {gated} THEN violated_rule END AS violated_rule, t1f AS feedback, done,
                CASE WHEN done THEN loc ELSE {D(0.0)} END AS r_loc, CASE WHEN done THEN bl ELSE {D(0.0)} END AS r_blame,
                CASE WHEN done THEN fx ELSE {D(0.0)} END AS r_fix, CASE WHEN done THEN pr ELSE {D(0.0)} END AS r_prec,
                CASE WHEN done THEN tot ELSE {D(0.0)} END AS reward FROM g6)""",
    ]


def _replay() -> str:
    return W(*_replay_ctes()) + "\nSELECT * FROM rep"


def _attempt_history() -> str:
    entry = "CAST(attempt_no AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || action_type || ':' || CAST(accepted AS VARCHAR)"
    return W(*_replay_ctes()) + f"""
SELECT c.episode_id, c.step_count, e.effective_attempts, c.step_count - coalesce(e.effective_attempts, 0) AS ignored_attempts,
       e.final_reward, e.history
FROM (SELECT episode_id, CAST(count(*) AS BIGINT) AS step_count FROM li_att GROUP BY episode_id) c
LEFT JOIN (SELECT episode_id, CAST(count(*) AS BIGINT) AS effective_attempts, max(CASE WHEN done THEN reward END) AS final_reward,
                  string_agg({entry}, ',' ORDER BY attempt_no) AS history FROM rep GROUP BY episode_id) e ON c.episode_id = e.episode_id"""


def _replay_all() -> str:
    kw, c = "expected_fix_keywords", "corrupted_output"
    rule = S.gate_rule("fault_step_id", "blame_role", "fix_content", "n_steps", c, kw)
    fb = S.gate_feedback("violated_rule", "fault_step_id", "blame_role", "n_steps", kw)
    zero = D(0.0)
    return W(S.LI_ATT, """j AS (SELECT a.*, b.curriculum_level, CAST(len(b.corrupted_pipeline) AS INTEGER) AS n_steps, b.injected_step,
                b.injected_role, b.original_output, b.corrupted_output, b.expected_fix_keywords
                FROM li_att a JOIN li_bank b ON a.episode_id = b.pipeline_id)""",
             f"g0 AS (SELECT *, {rule} AS violated_rule, action_type IN ('propose', 'revise') AS gated, "
             "row_number() OVER (PARTITION BY episode_id ORDER BY attempt_no) AS rn FROM j)",
             f"g1 AS (SELECT *, violated_rule IS NULL AS ok, {fb} AS fb FROM g0)",
             "g2 AS (SELECT *, min(CASE WHEN gated AND NOT ok THEN rn END) OVER (PARTITION BY episode_id) AS r FROM g1)",
             """g3 AS (SELECT *, coalesce(rn = r, false) AS told, coalesce(rn > r, false) AS past,
                    max(CASE WHEN rn = r THEN fb END) OVER (PARTITION BY episode_id) AS text,
                    coalesce(last_value(CASE WHEN gated THEN ok END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY attempt_no
                             ROWS UNBOUNDED PRECEDING), false) AS acc FROM g2)""",
             "g4 AS (SELECT *, CASE WHEN past THEN 2 ELSE 1 END AS turn FROM g3)",
             f"""g5 AS (SELECT *, {S.loc('fault_step_id', 'injected_step', 'curriculum_level')} AS loc,
                    {S.blame('blame_role', 'injected_role')} AS bl, {S.fix_score('fix_content', 'original_output', kw, c, True)} AS fx,
                    {S.precision('turn', 'acc')} AS pr FROM g4)""",
             f"g6 AS (SELECT *, {S.round4(S.wtotal('loc', 'bl', 'fx', 'pr'))} AS tot FROM g5)") + f"""
SELECT episode_id, attempt_no, turn, action_type, gated AND ok AS accepted, CASE WHEN gated THEN violated_rule END AS violated_rule,
       CASE WHEN past OR told THEN text END AS feedback, NOT told AS done,
       CASE WHEN told THEN {zero} ELSE loc END AS r_loc, CASE WHEN told THEN {zero} ELSE bl END AS r_blame,
       CASE WHEN told THEN {zero} ELSE fx END AS r_fix, CASE WHEN told THEN {zero} ELSE pr END AS r_prec,
       CASE WHEN told THEN {zero} ELSE tot END AS reward,
       rn > CASE WHEN r = 1 THEN 2 ELSE 1 END AS ignored FROM g6"""


def _level_or_all() -> str:
    return S.with_(*CV) + """
SELECT 3 AS requested, pipeline_id FROM cv_bank WHERE curriculum_level = 3 OR NOT EXISTS (SELECT 1 FROM cv_bank WHERE curriculum_level = 3)
UNION ALL
SELECT 4 AS requested, pipeline_id FROM cv_bank WHERE curriculum_level = 4 OR NOT EXISTS (SELECT 1 FROM cv_bank WHERE curriculum_level = 4)"""


def _bank_stats() -> str:
    dims = ["curriculum_level", "injected_step", "injected_role", "error_type", "domain"]
    parts = [f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM li_bank GROUP BY {d}"
             for d in dims]
    parts.append("SELECT 'total' AS dimension, 'all' AS value, CAST(count(*) AS BIGINT) AS n FROM li_bank")
    parts.append("SELECT 'unique_ids' AS dimension, 'all' AS value, CAST(count(DISTINCT pipeline_id) AS BIGINT) AS n FROM li_bank")
    return W() + "\n" + " UNION ALL ".join(parts)


def _uniformity_sql(src: str, include_zero: bool) -> str:
    per = f"SELECT CAST(len(corrupted_pipeline) AS INTEGER) AS plen, injected_step, count(*) AS obs FROM {src} GROUP BY ALL"
    if include_zero:
        per = (f"SELECT s.plen, s.injected_step, coalesce(p.obs, 0) AS obs FROM "
               f"(SELECT plen, unnest(range(1, plen + 1)) AS injected_step FROM (SELECT DISTINCT plen FROM ({per}))) s "
               f"LEFT JOIN ({per}) p ON s.plen = p.plen AND s.injected_step = p.injected_step")
    chi = "CAST(num AS DOUBLE) / CAST(plen * n_episodes AS DOUBLE)"
    return f"""SELECT CAST(plen AS INTEGER) AS plen, CAST(n_episodes AS BIGINT) AS n_episodes, CAST(steps_seen AS BIGINT) AS steps_seen,
       {chi} AS chi2, CASE WHEN {chi} < 20 THEN 'ok' WHEN {chi} < 50 THEN 'warn' ELSE 'fail' END AS status
FROM (SELECT p.plen, t.n_episodes, sum(CAST(p.plen * p.obs - t.n_episodes AS HUGEINT) * CAST(p.plen * p.obs - t.n_episodes AS HUGEINT)) AS num,
             count(*) AS steps_seen
      FROM ({per}) p JOIN (SELECT plen, sum(obs) AS n_episodes FROM ({per}) GROUP BY plen) t ON p.plen = t.plen
      GROUP BY p.plen, t.n_episodes)"""


def _role_share_sql(src: str) -> str:
    pct = f"CAST(count(*) AS DOUBLE) * {D(100.0)} / CAST((SELECT count(*) FROM {src}) AS DOUBLE)"
    return (f"SELECT injected_role, CAST(count(*) AS BIGINT) AS n, {pct} AS pct, {pct} <= {D(60.0)} AS within_limit "
            f"FROM {src} GROUP BY injected_role")


def _guess_sql(src: str) -> str:
    sh = f"CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM {src}) AS DOUBLE)"
    return (f"SELECT CAST(injected_step AS VARCHAR) AS guess, CAST(count(*) AS BIGINT) AS n, {sh} AS share, "
            f"{sh} < {D(0.4)} AS passes FROM {src} GROUP BY injected_step")


KWQ = ("SELECT CAST(count(*) AS BIGINT) AS n_episodes, CAST(count_if(coalesce(len(expected_fix_keywords), 0) = 0) AS BIGINT) "
       "AS empty_keywords, CAST(count_if(coalesce(len(expected_fix_keywords), 0) > 0 AND list_bool_and(list_transform("
       "expected_fix_keywords, lambda k: length(k) <= 2))) AS BIGINT) AS trivial_keywords FROM {src}")
NOOP = ("SELECT CAST(count(*) AS BIGINT) AS n_episodes, CAST(count_if(original_output IS NOT DISTINCT FROM corrupted_output) "
        "AS BIGINT) AS identical FROM {src}")


def _audit_bank() -> str:
    u = _uniformity_sql("li_bank", False)
    return W() + f"""
SELECT 'step_uniformity' AS "check", 'plen=' || CAST(plen AS VARCHAR) AS subject, chi2 AS value, status FROM ({u})
UNION ALL SELECT 'role_share', injected_role, pct, CASE WHEN within_limit THEN 'ok' ELSE 'warn' END FROM ({_role_share_sql('li_bank')})
UNION ALL SELECT 'error_mix', 'level=' || CAST(curriculum_level AS VARCHAR) || ' ' || error_type, CAST(count(*) AS DOUBLE), 'info'
          FROM li_bank GROUP BY curriculum_level, error_type
UNION ALL SELECT 'keyword_quality', 'empty', CAST(empty_keywords AS DOUBLE), CASE WHEN empty_keywords = 0 THEN 'ok' ELSE 'warn' END
          FROM ({KWQ.format(src='li_bank')})
UNION ALL SELECT 'keyword_quality', 'trivial', CAST(trivial_keywords AS DOUBLE), CASE WHEN trivial_keywords = 0 THEN 'ok' ELSE 'warn' END
          FROM ({KWQ.format(src='li_bank')})
UNION ALL SELECT 'noop_corruptions', 'identical', CAST(identical AS DOUBLE), CASE WHEN identical = 0 THEN 'ok' ELSE 'warn' END
          FROM ({NOOP.format(src='li_bank')})
UNION ALL SELECT 'constant_guess', 'step=1', share, CASE WHEN passes THEN 'ok' ELSE 'fail' END FROM ({_guess_sql('li_bank')}) WHERE guess = '1'"""


def _validate_bank() -> str:
    missing = "array_to_string(list_filter([CASE WHEN injected_role IS NULL THEN 'injected_role' END, CASE WHEN error_type IS NULL THEN 'error_type' END], lambda x: x IS NOT NULL), ', ')"
    return WB(S.planted("allbank")) + f"""
SELECT pipeline_id, 'missing fields: ' || {missing} AS finding FROM planted WHERE injected_role IS NULL OR error_type IS NULL
UNION ALL
SELECT pipeline_id, 'empty expected_fix_keywords' AS finding FROM planted WHERE coalesce(len(expected_fix_keywords), 0) = 0
UNION ALL
SELECT NULL AS pipeline_id, 'Duplicate IDs found: ' || CAST(count(*) AS VARCHAR) || ' episodes but ' ||
       CAST(count(DISTINCT pipeline_id) AS VARCHAR) || ' unique IDs' AS finding
FROM planted HAVING count(*) <> count(DISTINCT pipeline_id)"""


LOG = S.with_(S.EV_LOG)


def L(*ctes: str) -> str:
    return S.with_(S.EV_LOG, *ctes)


NRUN = "nr AS (SELECT run_id, CAST(count(*) AS BIGINT) AS n FROM rlog GROUP BY run_id)"


def _cum(cols) -> str:
    s_ = ", ".join(f"sum({S.un(c)}) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS cum_{c}" for c in cols)
    return f"cm AS (SELECT run_id, step, {s_} FROM rlog)"


def _rolling(cols, policy: str, src_cols=None) -> str:
    d5 = "least(50, CAST(floor(n / 5) AS BIGINT))"
    w = {"a": f"CASE WHEN n > 10 THEN {d5} END",
         "c": f"CASE WHEN n > 20 THEN {d5} END",
         "b": f"CASE WHEN n > 20 THEN {d5} WHEN n > 5 THEN 5 END",
         "interim": "CASE WHEN n > 10 THEN least(30, CAST(floor(n / 3) AS BIGINT)) END"}[policy]
    sel = ", ".join(
        f"CAST(a.cum_{c} - coalesce(b.cum_{c}, 0) AS DOUBLE) / CAST(a.w AS DOUBLE) / {D(1e12)} AS roll_{c}" for c in cols)
    return (f"ww AS (SELECT run_id, {w} AS w FROM nr), "
            f"aw AS (SELECT cm.*, ww.w FROM cm JOIN ww ON cm.run_id = ww.run_id WHERE ww.w > 1 AND cm.step >= ww.w)"
            ) + f"|SELECT a.run_id, a.step, CAST(a.w AS INTEGER) AS w, {sel} FROM aw a LEFT JOIN cm b ON a.run_id = b.run_id AND b.step = a.step - a.w"


def _rolling_q(cols, policy) -> str:
    ctes, sel = _rolling(cols, policy).split("|")
    return L(NRUN, _cum(cols), ctes) + "\n" + sel


def _rolling_accuracy() -> str:
    ctes, sel = _rolling(["correct"], "b").split("|")
    acc = (f"acc AS (SELECT run_id, step, CASE WHEN predicted_step = true_step THEN {D(1.0)} ELSE {D(0.0)} END AS correct FROM rlog)")
    cum = f"cm AS (SELECT run_id, step, sum({S.un('correct')}) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS cum_correct FROM acc)"
    return L(NRUN, acc, cum, ctes) + "\n" + sel.replace("FROM aw a", f", {D(1.0)} / {D(3.0)} AS chance FROM aw a")


def _trailing(w: int) -> str:
    return L() + f"""
SELECT run_id, step, CASE WHEN step >= {w} THEN CAST(s AS DOUBLE) / CAST(c AS DOUBLE) / {D(1e12)} END AS trailing_mean
FROM (SELECT run_id, step, sum({S.un('r_total')}) OVER wf AS s, count(*) OVER wf AS c FROM rlog
      WINDOW wf AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"""


def _curriculum(w: int, every: int) -> str:
    t1, t2 = 400_000_000_000 * w, 600_000_000_000 * w
    return L(f"""fr AS (SELECT run_id, step, sum({S.un('r_total')}) OVER (PARTITION BY run_id ORDER BY step
                  ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS s FROM rlog)""",
             f"cand AS (SELECT * FROM fr WHERE step >= {w} AND step % {every} = 0)",
             f"k1 AS (SELECT run_id, min(step) AS k1 FROM cand WHERE s > {t1} GROUP BY run_id)",
             f"k2 AS (SELECT c.run_id, min(c.step) AS k2 FROM cand c JOIN k1 ON c.run_id = k1.run_id WHERE c.step > k1.k1 AND c.s > {t2} GROUP BY c.run_id)") + """
SELECT r.run_id, r.step, CASE WHEN k1.k1 IS NULL OR r.step <= k1.k1 THEN 1 WHEN k2.k2 IS NULL OR r.step <= k2.k2 THEN 2 ELSE 3 END AS curriculum_level
FROM rlog r LEFT JOIN k1 ON r.run_id = k1.run_id LEFT JOIN k2 ON r.run_id = k2.run_id"""


def _final_mean() -> str:
    return L(NRUN) + f"""
SELECT r.run_id, CAST(sum({S.un('r_total')}) AS DOUBLE) / CAST(count(*) AS DOUBLE) / {D(1e12)} AS final_mean
FROM rlog r JOIN nr ON r.run_id = nr.run_id WHERE r.step > nr.n - 50 GROUP BY r.run_id"""


def _best_mean(last: bool = False) -> str:
    hi = "nr.n" if last else "greatest(least(50, nr.n), nr.n - 1)"
    return L(NRUN, f"""fr AS (SELECT run_id, step, sum({S.un('r_total')}) OVER (PARTITION BY run_id ORDER BY step
                  ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s FROM rlog)""") + f"""
SELECT f.run_id, CAST(max(s) AS DOUBLE) / {D(50.0)} / {D(1e12)} AS best_mean FROM fr f JOIN nr ON f.run_id = nr.run_id
WHERE f.step >= least(50, nr.n) AND f.step <= {hi} GROUP BY f.run_id"""


def _early_late(policy: str) -> str:
    ceil5 = "floor((n + 4) / 5)"
    if policy == "floor_ceil":
        ke, kl = "floor(n / 5)", ceil5
    else:
        ke = kl = "greatest(floor(n / 5), 1)"
    v = S.un("r_total")
    hit = "CASE WHEN predicted_step = true_step THEN 1 ELSE 0 END"

    def seg(cond):
        return f"(CAST(sum(CASE WHEN {cond} THEN {v} END) AS DOUBLE) / CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE))"

    e, l_ = f"step <= {ke}", f"step > n - {kl}"
    ae, al = "step <= floor(n / 5)", f"step > n - {ceil5}"
    return L(NRUN, "d AS (SELECT r.*, nr.n FROM rlog r JOIN nr ON r.run_id = nr.run_id)") + f"""
SELECT run_id, n, early_mean, late_mean, late_mean - early_mean AS improvement,
       CAST(coalesce(he, 0) AS DOUBLE) / CAST(greatest(ne, 1) AS DOUBLE) AS early_accuracy,
       CAST(coalesce(hl, 0) AS DOUBLE) / CAST(greatest(nl, 1) AS DOUBLE) AS late_accuracy
FROM (SELECT run_id, min(n) AS n, {seg(e)} / {D(1e12)} AS early_mean, {seg(l_)} / {D(1e12)} AS late_mean,
             sum(CASE WHEN {ae} THEN {hit} END) AS he, count(CASE WHEN {ae} THEN 1 END) AS ne,
             sum(CASE WHEN {al} THEN {hit} END) AS hl, count(CASE WHEN {al} THEN 1 END) AS nl
      FROM d GROUP BY run_id)"""


def _early_late_by_level() -> str:
    v = S.un("r_total")
    return L(NRUN, "d AS (SELECT r.*, nr.n, greatest(floor(nr.n / 5), 10) AS n5 FROM rlog r JOIN nr ON r.run_id = nr.run_id)",
             f"""g AS (SELECT run_id, level, sum(CASE WHEN step <= n5 THEN {v} END) AS sf, count(CASE WHEN step <= n5 THEN 1 END) AS cf,
                   sum(CASE WHEN step > n - n5 THEN {v} END) AS sl, count(CASE WHEN step > n - n5 THEN 1 END) AS cl
                   FROM d GROUP BY run_id, level)""",
             "sp AS (SELECT run_id, unnest([1, 2, 3]) AS level FROM nr)") + f"""
SELECT sp.run_id, CAST(sp.level AS INTEGER) AS level,
       CASE WHEN coalesce(g.cf, 0) > 0 THEN CAST(g.sf AS DOUBLE) / CAST(g.cf AS DOUBLE) / {D(1e12)} ELSE {D(0.0)} END AS first_mean,
       CASE WHEN coalesce(g.cl, 0) > 0 THEN CAST(g.sl AS DOUBLE) / CAST(g.cl AS DOUBLE) / {D(1e12)} ELSE {D(0.0)} END AS last_mean
FROM sp LEFT JOIN g ON sp.run_id = g.run_id AND sp.level = g.level"""


def _run_status() -> str:
    return L(NRUN) + f"""
SELECT nr.run_id, nr.n AS completions, b.level, coalesce(t.recent_mean, {D(0.0)}) AS recent_mean, CAST(2000 AS BIGINT) AS planned_total
FROM nr JOIN (SELECT run_id, arg_max(level, step) AS level FROM rlog GROUP BY run_id) b ON nr.run_id = b.run_id
LEFT JOIN (SELECT r.run_id, {S.un_mean('r_total')} AS recent_mean FROM rlog r JOIN nr ON r.run_id = nr.run_id
           WHERE r.step > nr.n - 30 GROUP BY r.run_id) t ON nr.run_id = t.run_id"""


def fmt4(b: str) -> str:
    return f"(CAST({b} // 10000 AS VARCHAR) || '.' || lpad(CAST({b} % 10000 AS VARCHAR), 4, '0'))"


def py_str4(b: str) -> str:
    frac = f"regexp_replace(lpad(CAST({b} % 10000 AS VARCHAR), 4, '0'), '0+$', '')"
    return f"(CAST({b} // 10000 AS VARCHAR) || '.' || CASE WHEN {frac} = '' THEN '0' ELSE {frac} END)"


FAILS = (f"{S.draw('8', 'task', q('fail'))} = 0 AND step_no = {S.draw('3', 'task', q('failat'))} + 1")
TASKS = [("tk0 AS (SELECT 'run' || CAST(run_id AS VARCHAR) || '_' || CAST(CAST(floor((step - 1) / 10) AS BIGINT) AS VARCHAR) AS task, "
          "(step - 1) % 10 + 1 AS step_no, step, predicted_step, predicted_role, r_total AS reward, "
          + S.bp("r_total") + " AS b FROM rlog)"),
         f"tk AS (SELECT *, CASE WHEN {FAILS} THEN 'model gave no answer at step ' || CAST(step_no AS VARCHAR) END AS error FROM tk0)",
         f"""per AS (SELECT task, count(*) AS n, sum(b) AS sb, max(step_no) AS last, arg_min(error, step_no) FILTER (WHERE error IS NOT NULL) AS error,
                 string_agg({fmt4('b')}, ',' ORDER BY step_no) AS rs FROM tk GROUP BY task)"""]
SCORE_BP = f"floor(CAST(sb AS DOUBLE) / CAST(n AS DOUBLE) + {D(0.5)})"


def _task_rows(rewards: bool = True) -> str:
    return (f"SELECT task, CASE WHEN error IS NULL THEN CAST(n AS BIGINT) ELSE 0 END AS steps, "
            f"CASE WHEN error IS NULL THEN CAST({SCORE_BP} AS DOUBLE) / {D(10000.0)} ELSE {D(0.0)} END AS score, "
            f"error IS NULL AS success, " + ("CASE WHEN error IS NULL THEN rs ELSE '' END AS rewards, " if rewards else "") + "error")


def _task_score() -> str:
    return L(*TASKS) + "\n" + _task_rows() + " FROM per"


def _parse_eval_ends() -> str:
    return L(*TASKS) + "\n" + _task_rows() + ", true AS parsed FROM per"


def _eval_log_files() -> str:
    return L(*TASKS) + "\n" + _task_rows(False) + " FROM per"


def _eval_log() -> str:
    sb = f"CAST({SCORE_BP} AS BIGINT)"
    return L(*TASKS) + f"""
SELECT task, CAST(0 AS BIGINT) AS seq, '[START] task=' || task || ' env={K.DEFAULT_ENV_NAME} model=baseline_random' AS line FROM per
UNION ALL
SELECT tk.task, CAST(tk.step_no AS BIGINT), '[STEP]  step=' || CAST(tk.step_no AS VARCHAR) || ' action=fault_step=' ||
       CAST(tk.predicted_step AS VARCHAR) || ',role=' || tk.predicted_role || ' reward=' || {fmt4('tk.b')} || ' done=' ||
       CASE WHEN tk.step_no = per.last THEN 'true' ELSE 'false' END || ' error=null'
FROM tk JOIN per ON tk.task = per.task WHERE per.error IS NULL
UNION ALL
SELECT task, CAST(last + 1 AS BIGINT), CASE WHEN error IS NULL THEN '[END]   success=true steps=' || CAST(n AS VARCHAR) || ' score=' ||
       {py_str4(sb)} || ' rewards=' || rs ELSE '[END]   success=false steps=0 score=0.0 rewards= error=' || error END FROM per"""


def _parse_eval_log() -> str:
    return L(*TASKS) + f"""
SELECT tk.task, CAST(tk.step_no AS BIGINT) AS step_no, CAST(tk.predicted_step AS BIGINT) AS predicted_step, tk.predicted_role,
       CAST({fmt4('tk.b')} AS DOUBLE) AS reward, tk.step_no = per.last AS done, CAST(NULL AS VARCHAR) AS error, true AS parsed
FROM tk JOIN per ON tk.task = per.task WHERE per.error IS NULL"""


def _steps_text(col: str) -> str:
    nl = "chr(10)"
    return (f"array_to_string(list_transform({col}, lambda x: {nl} || '--- Step ' || CAST(x.step_id AS VARCHAR) || ' (' || "
            f"x.role || ') ---' || {nl} || x.output || {nl}), '')")


def _prompt(tmpl: str) -> str:
    head, rest = tmpl.split("{brief}")
    mid, tail = rest.split("{steps}")
    return f"({q(head)} || task_brief || {q(mid)} || {_steps_text('corrupted_pipeline')} || {q(tail)})"


def _render_prompt() -> str:
    return W() + (f"\nSELECT pipeline_id, {_prompt(K.PROMPT_USER_LENIENT)} AS prompt_lenient, "
                  f"{_prompt(K.PROMPT_USER_COMPACT)} AS prompt_compact FROM li_bank")


def _messages() -> str:
    system = K.SYSTEM_PROMPT_COMPACT.format(name=K.DEFAULT_AGENT_NAME)
    return W() + (f"\nSELECT pipeline_id, 'system,user' AS roles, {q(system)} AS system, "
                  f"{_prompt(K.PROMPT_USER_COMPACT)} AS user FROM li_bank")


def _train_scores(src: str, level: str) -> str:
    fix, o, kw, c = "fix_content", "original_output", "expected_fix_keywords", "corrupted_output"
    return (f"SELECT *, {S.loc('fault_step_id', 'injected_step', level)} AS loc, {S.blame('blame_role', 'injected_role')} AS bl, "
            f"{S.fix_score(fix, o, kw, c, False)} AS fx, {D(0.2)} AS pr FROM {src}")


LOG_ROW = (f"pipeline_id, loc AS r_loc, bl AS r_blame, fx AS r_fix, pr AS r_prec, {S.wtotal('loc', 'bl', 'fx', 'pr')} AS r_total, "
           "CAST(fault_step_id AS INTEGER) AS predicted_step, CAST(injected_step AS INTEGER) AS true_step, "
           "blame_role AS predicted_role, injected_role AS true_role")


def _parsed_runs() -> list[str]:
    cols = ", ".join(f"{v} AS {k}" for k, v in S.parse_sql("text", True).items())
    return [S.LI_ACT, S.LI_COMP, f"""pc AS (SELECT bank_pos AS completion_no, bank_pos % 4 AS run_id,
            row_number() OVER (PARTITION BY bank_pos % 4 ORDER BY bank_pos) AS step, {cols} FROM li_comp)"""]


def _score_completions() -> str:
    return W(*_parsed_runs(), _pool(1),
             "a AS (SELECT pc.*, pool.* FROM pc JOIN pool ON pc.completion_no % (SELECT n FROM pool_n) = pool.level_idx)",
             f"sc AS ({_train_scores('a', '1')})") + f"\nSELECT run_id, step, 1 AS level, {LOG_ROW} FROM sc"


def _score_completions_curriculum() -> str:
    w, t1, t2 = 30, 200_000_000_000 * 30, 250_000_000_000 * 30
    frame = f"OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return W(*_parsed_runs(),
             "lv AS (SELECT unnest([1, 2, 3]) AS run_level)",
             "held AS (SELECT curriculum_level, count(*) AS n FROM li_bank GROUP BY curriculum_level)",
             # an empty level stands for the whole bank
             """pk AS (SELECT curriculum_level AS run_level, pipeline_id, bank_pos FROM li_bank WHERE curriculum_level IN (1, 2, 3)
                  UNION ALL SELECT lv.run_level, pipeline_id, bank_pos FROM lv, li_bank WHERE lv.run_level NOT IN (SELECT curriculum_level FROM held))""",
             "pl AS (SELECT *, row_number() OVER (PARTITION BY run_level ORDER BY bank_pos) - 1 AS level_idx FROM pk)",
             "sz AS (SELECT run_level, count(*) AS size FROM pk GROUP BY run_level)",
             "pcl AS (SELECT pc.*, sz.run_level, (pc.step - 1) % sz.size AS level_idx FROM pc, sz)",
             """a AS (SELECT pcl.* EXCLUDE (level_idx), b.* FROM pcl JOIN pl ON pl.run_level = pcl.run_level AND pl.level_idx = pcl.level_idx
                  JOIN li_bank b ON b.pipeline_id = pl.pipeline_id)""",
             f"sc AS ({_train_scores('a', 'run_level')})",
             f"r AS (SELECT run_id, step, run_level AS level, {LOG_ROW} FROM sc)",
             f"f1 AS (SELECT run_id, step, sum({S.un('r_total')}) {frame} AS s FROM r WHERE level = 1)",
             f"k1 AS (SELECT run_id, min(step) AS k1 FROM f1 WHERE step >= {w} AND step % 20 = 0 AND s > {t1} GROUP BY run_id)",
             """two AS (SELECT r.*, k1.k1 FROM r LEFT JOIN k1 ON r.run_id = k1.run_id
                  WHERE r.level = CASE WHEN r.step > k1.k1 THEN 2 ELSE 1 END)""",
             f"f2 AS (SELECT run_id, step, k1, sum({S.un('r_total')}) {frame} AS s FROM two)",
             f"k2 AS (SELECT run_id, min(step) AS k2 FROM f2 WHERE step >= {w} AND step % 20 = 0 AND step > k1 AND s > {t2} GROUP BY run_id)") + """
SELECT r.* FROM r LEFT JOIN k1 ON r.run_id = k1.run_id LEFT JOIN k2 ON r.run_id = k2.run_id
WHERE r.level = CASE WHEN r.step > k2.k2 THEN 3 WHEN r.step > k1.k1 THEN 2 ELSE 1 END"""


def _score_stream() -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in S.parse_sql("text", True).items())
    return W(S.LI_ACT, S.LI_COMP, f"pc AS (SELECT pipeline_id, {cols} FROM li_comp)",
             "a AS (SELECT b.*, pc.* EXCLUDE (pipeline_id) FROM pc JOIN li_bank b ON pc.pipeline_id = b.pipeline_id)",
             f"sc AS ({_train_scores('a', 'curriculum_level')})") + (
        f"\nSELECT pipeline_id, fault_step_id, blame_role, loc AS localization, bl AS blame, fx AS fix, pr AS precision, "
        f"{S.wtotal('loc', 'bl', 'fx', 'pr')} AS total FROM sc")


def _score_stream_late() -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in S.parse_sql("text", True).items())
    kind = S.draw("5", "pipeline_id", q("truthdelay"))  # known before, soon, just in time, too late, never
    when = lambda x: f"CASE WHEN known THEN {x} END"
    return W(S.LI_ACT, S.LI_COMP, f"pc AS (SELECT pipeline_id, {kind} <= 2 AS known, {cols} FROM li_comp)",
             "a AS (SELECT b.*, pc.* EXCLUDE (pipeline_id) FROM pc JOIN li_bank b ON pc.pipeline_id = b.pipeline_id)",
             f"sc AS ({_train_scores('a', 'curriculum_level')})") + (
        f"\nSELECT pipeline_id, fault_step_id, blame_role, known AS scored, {when('loc')} AS localization, {when('bl')} AS blame, {when('fx')} AS fix, "
        f"{when('pr')} AS precision, {when(S.wtotal('loc', 'bl', 'fx', 'pr'))} AS total FROM sc")


def _curriculum_stream() -> str:
    sql = _curriculum(100, 1)
    return sql.replace(" AS curriculum_level\nFROM rlog", " AS curriculum_level, false AS late, "
                       "r.step >= 50 AND r.step % 50 < 4 AS snapshot\nFROM rlog")


def _decode_results() -> str:
    some = lambda tag: f"{S.draw('3', 'pipeline_id', q(tag))} > 0"
    return W() + f"""
SELECT pipeline_id, {_steps_text('corrupted_pipeline')} AS pipeline_text, CASE WHEN {some('nobrief')} THEN task_brief ELSE '' END AS task_brief,
       CAST(CASE WHEN {some('noturn')} THEN 2 ELSE 1 END AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS gatekeeper_feedback,
       CAST(CASE WHEN {some('nolevel')} THEN curriculum_level ELSE 1 END AS BIGINT) AS curriculum_level,
       {some('nodone')} AS done, {D(0.25)} AS reward, pipeline_id AS episode_id,
       CAST(CASE WHEN {some('nocount')} THEN injected_step ELSE 0 END AS BIGINT) AS step_count, '{{}}' AS metadata FROM li_bank"""


def _encode_actions() -> str:
    return W(S.LI_ACT) + (f"\nSELECT pipeline_id, '{{\"fault_step_id\":' || CAST(fault_step_id AS VARCHAR) || ',\"blame_role\":' || {S.json_str('blame_role')} "
                          f"|| ',\"fix_content\":' || {S.json_str('fix_content')} || ',\"action_type\":' || {S.json_str('action_type')} || '}}' AS payload FROM li_act")


def _grade_empty() -> str:
    rows = ", ".join(f"({lv}, {D(t)})" for lv, t in K.TARGET_MEAN_BY_LEVEL.items())
    return (f"SELECT CAST(level AS INTEGER) AS level, CAST(NULL AS VARCHAR) AS pipeline_id, {D(0.0)} AS localization, {D(0.0)} AS blame, {D(0.0)} AS fix, "
            f"{D(0.5)} AS precision, {D(0.05)} AS total, target, false AS meets_target FROM (VALUES {rows}) t(level, target)")


ORACLES.update({
    "replay": _replay(),
    "attempt_history": _attempt_history(),
    "level_or_all": _level_or_all(),
    "validate_bank": _validate_bank(),
    "bank_stats": _bank_stats(),
    "step_uniformity": WB() + "\n" + _uniformity_sql("allbank", False),
    "step_uniformity_zero": WB() + "\n" + _uniformity_sql("allbank", True),
    "role_share": W() + "\n" + _role_share_sql("li_bank"),
    "error_mix": W() + "\nSELECT curriculum_level, error_type, CAST(count(*) AS BIGINT) AS n FROM li_bank GROUP BY ALL",
    "keyword_quality": WB(S.planted("allbank")) + "\n" + KWQ.format(src="planted"),
    "noop_corruptions": WB() + "\n" + NOOP.format(src="allbank"),
    "constant_guess": W() + "\n" + _guess_sql("li_bank"),
    "audit_bank": _audit_bank(),
    "reward_log": LOG + "\nSELECT * FROM rlog",
    "mean_by_level": LOG + (f"\nSELECT level, CAST(count(*) AS BIGINT) AS n, {S.un_mean('r_total')} AS mean_r_total, "
                            f"{S.un_mean('r_loc')} AS mean_r_loc, {S.un_mean('r_fix')} AS mean_r_fix FROM rlog GROUP BY level"),
    "trailing_mean": _trailing(100),
    "rolling_curve": _rolling_q(["r_total", "r_loc", "r_blame", "r_fix", "r_prec"], "c"),
    "rolling_curve_interim": _rolling_q(["r_total"], "interim"),
    "rolling_accuracy": _rolling_accuracy(),
    "curriculum_env": _curriculum(100, 1),
    "curriculum_trainer": _curriculum(30, 20),
    "final_mean": _final_mean(),
    "best_mean": _best_mean(),
    "early_late": _early_late("floor_ceil"),
    "early_late_floor": _early_late("floor_floor"),
    "early_late_by_level": _early_late_by_level(),
    "run_status": _run_status(),
    "task_score": _task_score(),
    "observation_view": W() + (f"\nSELECT pipeline_id, task_brief, 1 AS turn, CAST(NULL AS VARCHAR) AS gatekeeper_feedback, "
                               f"curriculum_level, {_steps_text('corrupted_pipeline')} AS pipeline_text FROM li_bank"),
    "truth_view": W() + (f"\nSELECT pipeline_id, curriculum_level, CAST(len(corrupted_pipeline) AS INTEGER) AS n_steps, "
                         f"injected_step, injected_role, error_type, error_description, original_output, corrupted_output, "
                         f"array_to_string(expected_fix_keywords, '|') AS keywords, {_steps_text('clean_pipeline')} AS clean_text FROM li_bank"),
    "explode_steps": W() + ("\nSELECT pipeline_id, s.step_id, s.role, s.output FROM "
                            "(SELECT pipeline_id, unnest(corrupted_pipeline) AS s FROM li_bank)"),
    "render_prompt": _render_prompt(),
    "messages": _messages(),
    "eval_log": _eval_log(),
    "parse_eval_log": _parse_eval_log(),
    "score_completions": _score_completions(),
    "score_completions_curriculum": _score_completions_curriculum(),
    "validate_observations": _validate_observations(),
    "bank_of_tables": _bank_of_tables(),
    "replay_all": _replay_all(),
    "grade_empty": _grade_empty(),
    "rolling_curve_a": _rolling_q(["r_total"], "a"),
    "curriculum_batch": _curriculum(50, 4),
    "best_mean_last": _best_mean(True),
    "parse_eval_ends": _parse_eval_ends(),
    "eval_log_files": _eval_log_files(),
    "bank_json": S.bank_query("li"),
    "bank_level": S.bank_query("li") + " WHERE curriculum_level = 2",
    "reward_log_files": _run_status(),
    "encode_actions": _encode_actions(),
    "decode_results": _decode_results(),
    "score_stream": _score_stream(),
    "curriculum_stream": _curriculum_stream(),
    "replay_stream": _replay(),
    "score_stream_late": _score_stream_late(),
    "curriculum_batches": _curriculum_stream(),
    "replay_events": _replay(),
    "rolling_curve_appended": _rolling_q(["r_total", "r_loc", "r_blame", "r_fix", "r_prec"], "c"),
    "curriculum_appended": _curriculum(100, 1),
    "early_late_appended": _early_late("floor_ceil"),
})

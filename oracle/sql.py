"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code as plain SQL over the driver's
views (``lineitem``, ``conversations``, ``events`` ...). Only the fixed
values (swap banks, word lists, weights) are shared, by import. Scores are
computed with the same operation order and explicit DOUBLE casts, which
makes doubles bit-identical between the engines.

Text-regex note: DuckDB's RE2 has no look-around, so a whole number is
``\\b[0-9]+\\b`` here; it equals the Spark pattern on ASCII text, which is
what the numeric traces contain.
"""

from __future__ import annotations

from faultlens.functions import constants as K

SEED = 42
WS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\p{Z}]"
NUM = r"\b[0-9]+\b"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def swaps(pairs) -> str:
    return "[" + ", ".join(f"{{'i': {i}, 'find': {q(a)}, 'repl': {q(b)}}}" for i, (a, b) in enumerate(pairs)) + "]"


def key(*parts: str) -> str:
    return "concat_ws(':', " + ", ".join([q(str(SEED))] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"


def u32(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({key(*parts)}), 1, 8) AS BIGINT)"


def draw(n: str, *parts: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN {u32(*parts)} % ({n}) END)"


def elem(values, idx0: str) -> str:
    return f"({lst(values)})[({idx0}) + 1]"


def D(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def replace_first(t: str, f: str, r: str) -> str:
    return (
        f"(CASE WHEN strpos({t}, {f}) > 0 THEN substr({t}, 1, strpos({t}, {f}) - 1) || {r} || "
        f"substr({t}, strpos({t}, {f}) + length({f})) ELSE {t} END)"
    )


PRIO_HEX = 6


def perm(pid: str, tag: str, n_pairs: int) -> str:
    n_md5 = (PRIO_HEX * n_pairs + 31) // 32
    return "(" + " || ".join(f"md5({key(pid, q(tag), q(str(j)))})" for j in range(n_md5)) + ")"


def first_hit(t: str, pairs, pid: str, tag: str, ci: bool = False) -> str:
    arr = swaps(pairs)
    hay = f"lower({t})" if ci else t
    needle = "lower(s.find)" if ci else "s.find"
    pm = perm(pid, tag, len(pairs))
    prio = f"CAST('0x' || substr({pm}, {PRIO_HEX} * s.i + 1, {PRIO_HEX}) AS BIGINT) * 4294967296 + s.i"
    best = f"list_min(list_transform(list_filter({arr}, lambda s: strpos({hay}, {needle}) > 0), lambda s: {prio}))"
    return f"({arr})[({best}) % 4294967296 + 1]"


def inject_sql(t: str, et: str, pid: str) -> str:
    wt = first_hit(t, K.TYPE_SWAPS, pid, "type")
    fa = first_hit(t, K.FACTUAL_SWAPS, pid, "fact", ci=True)
    rg = first_hit(t, K.RANGE_SWAPS, pid, "range")
    lg = first_hit(t, K.LOGIC_SWAPS, pid, "logic")
    dp = first_hit(t, K.DEPENDENCY_SWAPS, pid, "dep")
    nums = f"regexp_extract_all({t}, {q(NUM)})"
    n = f"len({nums})"
    k = draw(n, pid, q("num"))
    delta = f"(CASE WHEN {draw('2', pid, q('sign'))} = 0 THEN -1 ELSE 1 END)"
    moved = f"CAST(TRY_CAST(({nums})[({k}) + 1] AS HUGEINT) + {delta} AS VARCHAR)"
    pieces = f"regexp_split_to_array({t}, {q(NUM)})"
    rebuilt = (
        f"array_to_string(list_transform({pieces}, lambda p, i: p || coalesce(CASE WHEN i - 1 = ({k}) "
        f"THEN {moved} ELSE ({nums})[i] END, '')), '')"
    )
    fpos = f"strpos(lower({t}), lower(({fa}).find))"
    return f"""(CASE {et}
      WHEN 'wrong_type' THEN (CASE WHEN ({wt}) IS NOT NULL THEN {replace_first(t, f'({wt}).find', f'({wt}).repl')}
                                   ELSE {replace_first(t, q('.'), q(K.WRONG_TYPE_NOTE))} END)
      WHEN 'factual_error' THEN (CASE WHEN ({fa}) IS NOT NULL
                                   THEN substr({t}, 1, {fpos} - 1) || ({fa}).repl || substr({t}, {fpos} + length(({fa}).find))
                                   ELSE {t} || {q(K.FACTUAL_FALLBACK)} END)
      WHEN 'off_by_one' THEN (CASE WHEN {n} > 0 AND {moved} IS NOT NULL THEN {rebuilt}
                                   WHEN {n} > 0 THEN {t}
                                   WHEN ({rg}) IS NOT NULL THEN {replace_first(t, f'({rg}).find', f'({rg}).repl')}
                                   ELSE {replace_first(t, q('.'), q(K.OFF_BY_ONE_NOTE))} END)
      WHEN 'logic_inversion' THEN (CASE WHEN ({lg}) IS NOT NULL THEN {replace_first(t, f'({lg}).find', f'({lg}).repl')}
                                   WHEN strpos({t}, 'correctly') > 0 THEN {replace_first(t, q('correctly'), q('incorrectly'))}
                                   ELSE {t} || {q(K.LOGIC_FALLBACK)} END)
      WHEN 'cascade_dependency' THEN (CASE WHEN ({dp}) IS NOT NULL THEN replace({t}, ({dp}).find, ({dp}).repl)
                                   WHEN strpos({t}, 'return') > 0 THEN {replace_first(t, q('return'), q('yield'))}
                                   ELSE {t} || {q(K.DEPENDENCY_FALLBACK)} END)
    END)"""


def keywords_sql(t: str, et: str) -> str:
    def or_default(found: str, default) -> str:
        return f"(CASE WHEN len({found}) > 0 THEN ({found})[1:{K.MAX_KEYWORDS}] ELSE {lst(default)} END)"

    fact = or_default(
        f"list_filter({lst([a for a, _ in K.FACTUAL_SWAPS])}, lambda x: contains(lower({t}), lower(x)))",
        K.KEYWORDS_FACTUAL_DEFAULT,
    )
    numeric = f"list_concat((regexp_extract_all({t}, {q(NUM)}))[1:3], {lst(K.KEYWORDS_NUMERIC_TAIL)})[1:{K.MAX_KEYWORDS}]"
    logic = or_default(
        f"list_filter({lst(K.LOGIC_TERMS)}, lambda x: contains(lower({t}), lower(x)))", K.KEYWORDS_LOGIC_DEFAULT
    )
    dep = or_default(f"list_filter({lst(K.DEPENDENCY_TERMS)}, lambda x: contains({t}, x))", K.KEYWORDS_DEPENDENCY_DEFAULT)
    return f"""(CASE {et}
      WHEN 'wrong_type' THEN {lst(K.KEYWORDS_WRONG_TYPE)}
      WHEN 'factual_error' THEN {fact}
      WHEN 'off_by_one' THEN {numeric}
      WHEN 'logic_inversion' THEN {logic}
      WHEN 'cascade_dependency' THEN {dep}
    END)"""


def description_sql(et: str, step: str, role: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.ERROR_DESCRIPTIONS.items())
    return f"((CASE {et} {cases} END) || ' at step ' || CAST({step} AS VARCHAR) || ' (' || {role} || ')')"


def level_sql(n: str) -> str:
    return f"(CASE WHEN {n} <= 3 THEN 1 WHEN {n} = 4 THEN 2 ELSE 3 END)"


def role_sql(idx0: str) -> str:
    return elem(K.ROLES, f"(({idx0}) % 3)")


def domain_sql(key_col: str) -> str:
    return elem(K.DOMAINS, f"(({key_col}) % {len(K.DOMAINS)})")


def s(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


# ---------------------------------------------------------------------------
# Bindings as CTEs
# ---------------------------------------------------------------------------

LI_STEPS = f"""
li_src AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem
),
li_line AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
              l_extendedprice) AS line FROM li_src
),
li_at AS (
  SELECT *, min(line) OVER (PARTITION BY l_orderkey) AS start, count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM li_line
),
li_num AS (
  SELECT *, CAST((line - start) % 6 + 1 AS INTEGER) AS step_id, (line - start) // 6 * 6 AS ahead,
         start + (line - start) // 6 * 6 - 1 AS trace_id, CAST(least(6, n_lines - (line - start) // 6 * 6) AS INTEGER) AS n_steps
  FROM li_at
),
li_role AS (
  SELECT *, {role_sql('step_id - 1')} AS role,
         {s('l_orderkey')} AS ok, {s('l_partkey')} AS pk, {s('l_suppkey')} AS sk, {s('l_linenumber')} AS ln,
         {s('CAST(floor(l_quantity) AS BIGINT)')} AS qq, {s('CAST(floor(l_extendedprice) AS BIGINT)')} AS pp
  FROM li_num
),
li_steps AS (
  SELECT trace_id, step_id, role,
    CASE role
      WHEN 'Researcher' THEN 'Line ' || ln || ' of order ' || ok || ': data for part ' || pk || ' from supplier ' || sk
           || ' arrives as sorted input in ascending order. The total quantity is ' || qq || ' units and the check is true.'
      WHEN 'Coder' THEN 'def load_' || ln || {q("(rows):" + chr(10) + "    results = [r for r in rows if int(r.part) == ")} || pk
           || {q("]" + chr(10) + "    if len(results) >= ")} || qq
           || {q(":" + chr(10) + "        return results" + chr(10) + "    return sorted(results, key=len)")}
      ELSE CASE WHEN l_partkey % 2 = 0
           THEN 'Tested ' || qq || ' cases for part ' || pk || ': accuracy is statistically significant, mean score '
                || pp || ', highest on line ' || ln || '.'
           ELSE 'Score for supplier ' || sk || ': ' || qq || ' units at price ' || pp
                || '. The model output is correct; max line is ' || ln || ' and top part is ' || pk || '.' END
    END AS output,
    'Reconcile order ' || ok || ': check ' || {s('n_steps')} || ' line items and report the totals.' AS task_brief,
    {domain_sql('l_orderkey')} AS domain, n_steps, {level_sql('n_steps')} AS curriculum_level
  FROM li_role
)"""

CV_STEPS = f"""
cv_src AS (SELECT conv_id, turn, text, conv_id * 1048576 + turn // 8 AS trace_id FROM conversations),
cv_sizes AS (SELECT trace_id, CAST(count(*) AS INTEGER) AS n_steps FROM cv_src GROUP BY trace_id),
cv_steps AS (
  SELECT a.trace_id, CAST(a.turn % 8 + 1 AS INTEGER) AS step_id, {role_sql('a.turn')} AS role,
         coalesce(a.text, '') AS output,
         'Continue conversation ' || {s('a.conv_id')} || ' over ' || {s('b.n_steps')} || ' turns.' AS task_brief,
         {domain_sql('a.conv_id')} AS domain, b.n_steps, {level_sql('b.n_steps')} AS curriculum_level
  FROM cv_src a JOIN cv_sizes b ON a.trace_id = b.trace_id
)"""


def bank_ctes(src: str, prefix: str) -> str:
    """Nested traces -> episodes for a ``{src}_steps`` CTE; defines
    ``{src}_bank``."""
    et = "error_type"
    return f"""
{src}_traces AS (
  SELECT trace_id, curriculum_level, task_brief, domain,
         list(struct_pack(step_id := step_id, role := role, output := output) ORDER BY step_id) AS steps
  FROM {src}_steps GROUP BY trace_id, curriculum_level, task_brief, domain
),
{src}_e0 AS (
  SELECT *, unnest(range(0, 5)) AS k FROM {src}_traces
),
{src}_e1 AS (
  SELECT trace_id * 5 + k AS bank_pos, {q(prefix + '_')} || {s('trace_id')} || '_err_' || {s('k')} AS pipeline_id,
         curriculum_level, task_brief, domain, steps AS clean_pipeline
  FROM {src}_e0
),
{src}_e2 AS (
  SELECT *, CAST({draw('len(clean_pipeline)', 'pipeline_id', q('step'))} + 1 AS INTEGER) AS injected_step,
         CASE curriculum_level
           WHEN 1 THEN {elem(K.ERROR_TYPES_BY_LEVEL[1], draw('2', 'pipeline_id', q('error')))}
           WHEN 2 THEN {elem(K.ERROR_TYPES_BY_LEVEL[2], draw('2', 'pipeline_id', q('error')))}
           WHEN 3 THEN {elem(K.ERROR_TYPES_BY_LEVEL[3], draw('1', 'pipeline_id', q('error')))}
         END AS error_type
  FROM {src}_e1
),
{src}_e3 AS (
  SELECT *, (clean_pipeline[injected_step]).role AS injected_role,
         (clean_pipeline[injected_step]).output AS original_output
  FROM {src}_e2
),
{src}_e4 AS (
  SELECT *, {inject_sql('original_output', et, 'pipeline_id')} AS corrupted_output FROM {src}_e3
),
{src}_bank AS (
  SELECT bank_pos, pipeline_id, curriculum_level, task_brief, domain, clean_pipeline,
         list_transform(clean_pipeline, lambda x: CASE WHEN x.step_id = injected_step
              THEN struct_pack(step_id := x.step_id, role := x.role, output := corrupted_output) ELSE x END)
              AS corrupted_pipeline,
         injected_step, injected_role, error_type,
         {description_sql(et, 'injected_step', 'injected_role')} AS error_description,
         original_output, corrupted_output,
         {keywords_sql('original_output', et)} AS expected_fix_keywords
  FROM {src}_e4
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


LI_BANK = with_(LI_STEPS, bank_ctes("li", "li"))
CV_BANK = with_(CV_STEPS, bank_ctes("cv", "cv"))

BANK_COLUMNS = """
  bank_pos, pipeline_id, curriculum_level, task_brief, domain, CAST(len(corrupted_pipeline) AS INTEGER) AS n_steps,
  injected_step, injected_role, error_type, error_description, original_output, corrupted_output,
  array_to_string(expected_fix_keywords, '|') AS keywords,
  array_to_string(list_transform(corrupted_pipeline, lambda x: x.output), '\n<>\n') AS corrupted_text,
  array_to_string(list_transform(clean_pipeline, lambda x: x.output), '\n<>\n') AS clean_text
"""


def bank_query(src: str) -> str:
    base = LI_BANK if src == "li" else CV_BANK
    return f"{base}\nSELECT {BANK_COLUMNS} FROM {src}_bank"


def planted(src: str) -> str:
    """A bank with drawn faults: see the plant binding."""
    return f"""
pl0 AS (SELECT * EXCLUDE (expected_fix_keywords, error_type, injected_role),
               {draw('40', 'pipeline_id', q('plant'))} AS fault, expected_fix_keywords AS kw0, error_type AS et0, injected_role AS ir0 FROM {src}),
pl1 AS (SELECT *, CASE fault WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a', 'of'] ELSE kw0 END AS expected_fix_keywords,
               CASE WHEN fault <> 2 THEN et0 END AS error_type, CASE WHEN fault NOT IN (2, 3) THEN ir0 END AS injected_role FROM pl0),
planted AS (SELECT * FROM pl1 UNION ALL SELECT * FROM pl1 WHERE fault = 4)"""


# ---------------------------------------------------------------------------
# Scoring fragments
# ---------------------------------------------------------------------------

def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda t: t <> '')"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {utrim(x)} = '')"


def hits(fix: str, kw: str) -> str:
    return f"len(list_filter({kw}, lambda k: contains(lower(coalesce({fix}, '')), lower(k))))"


def share(fix: str, kw: str, empty: float) -> str:
    return (f"(CASE WHEN coalesce(len({kw}), 0) > 0 THEN CAST({hits(fix, kw)} AS DOUBLE) / "
            f"CAST(len({kw}) AS DOUBLE) ELSE {D(empty)} END)")


def not_corrupt(fix: str, c: str) -> str:
    return f"(CASE WHEN coalesce({c}, '') <> '' AND lower({fix}) = lower(coalesce({c}, '')) THEN {D(0.0)} ELSE {D(1.0)} END)"


def length_fit(fix: str, o: str) -> str:
    r = f"(CAST(length({fix}) AS DOUBLE) / CAST(length(coalesce({o}, '')) AS DOUBLE))"
    return (f"(CASE WHEN coalesce({o}, '') = '' THEN {D(0.5)} WHEN {r} >= {D(0.3)} AND {r} <= {D(3.0)} THEN {D(1.0)} "
            f"WHEN {r} < {D(0.3)} THEN {r} / {D(0.3)} ELSE greatest({D(0.0)}, {D(1.0)} - ({r} - {D(3.0)}) / {D(7.0)}) END)")


def word_overlap(fix: str, o: str) -> str:
    ow = f"list_distinct({tokens(f'lower(coalesce({o}, ' + chr(39) * 2 + '))')})"
    return (f"(CASE WHEN len({ow}) > 0 THEN CAST(len(list_intersect({ow}, {tokens(f'lower({fix})')})) AS DOUBLE) / "
            f"CAST(len({ow}) AS DOUBLE) ELSE {D(0.0)} END)")


def round4(x: str) -> str:
    return f"(floor({x} * {D(10000.0)} + {D(0.5)}) / {D(10000.0)})"


def fix_score(fix: str, o: str, kw: str, c: str, rounded: bool) -> str:
    total = (f"({D(K.FIX_W_KEYWORD)} * {share(fix, kw, 0.5)} + {D(K.FIX_W_NOT_CORRUPT)} * {not_corrupt(fix, c)} + "
             f"{D(K.FIX_W_LENGTH)} * {length_fit(fix, o)} + {D(K.FIX_W_OVERLAP)} * {word_overlap(fix, o)})")
    clipped = f"least(greatest({total}, {D(0.0)}), {D(1.0)})"
    v = round4(clipped) if rounded else clipped
    return f"(CASE WHEN {is_blank(fix)} THEN {D(0.0)} ELSE {v} END)"


def fix_simple(fix: str, kw: str, empty: float, blank_zero: bool) -> str:
    s_ = share(fix, kw, empty)
    return f"(CASE WHEN {is_blank(fix)} THEN {D(0.0)} ELSE {s_} END)" if blank_zero else s_


def loc(pred: str, true: str, level: str) -> str:
    return (f"(CASE WHEN {pred} = {true} THEN {D(1.0)} WHEN {level} = 1 AND abs({pred} - {true}) = 1 THEN {D(0.3)} "
            f"ELSE {D(0.0)} END)")


def blame(pred: str, true: str) -> str:
    return f"(CASE WHEN {pred} = {true} THEN {D(1.0)} ELSE {D(0.0)} END)"


def precision(turn: str, acc: str) -> str:
    a = f"coalesce({acc}, false)"
    return (f"(CASE WHEN {turn} > {K.MAX_TURNS} THEN {D(0.0)} WHEN {a} AND {turn} = 1 THEN {D(1.0)} "
            f"WHEN {a} THEN {D(0.6)} ELSE {D(0.2)} END)")


def wtotal(r1: str, r2: str, r3: str, r4: str) -> str:
    return (f"({D(K.W_LOCALIZATION)} * {r1} + {D(K.W_BLAME)} * {r2} + {D(K.W_FIX)} * {r3} + "
            f"{D(K.W_PRECISION)} * {r4})")


# ---------------------------------------------------------------------------
# Gate fragments
# ---------------------------------------------------------------------------

def py_str(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def hint(kw: str) -> str:
    k = f"coalesce({kw}, []::VARCHAR[])"
    out = q(K.HINT_DEFAULT)
    for frag, area in reversed(K.HINT_AREAS):
        out = f"(CASE WHEN len(list_filter({k}, lambda x: contains(lower(x), {q(frag.lower())}))) > 0 THEN {q(area)} ELSE {out} END)"
    return out


def gate_rule(step: str, role: str, fix: str, n: str, c: str, kw: str) -> str:
    has_kw = f"len(list_filter(coalesce({kw}, []::VARCHAR[]), lambda k: contains(lower(coalesce({fix}, '')), lower(k)))) > 0"
    roles = ", ".join(q(r) for r in K.ROLES)
    return (f"(CASE WHEN {is_blank(fix)} THEN 'empty_fix' "
            f"WHEN {step} IS NULL OR {step} < 1 OR {step} > {n} THEN 'invalid_step_id' "
            f"WHEN {role} IS NULL OR {role} NOT IN ({roles}) THEN 'invalid_role' "
            f"WHEN lower({utrim(fix)}) = lower({utrim(f'coalesce({c}, {chr(39) * 2})')}) THEN 'identical_to_corrupt' "
            f"WHEN coalesce(len({kw}), 0) > 0 AND NOT ({has_kw}) THEN 'missing_keywords' END)")


def gate_feedback(rule: str, step: str, role: str, n: str, kw: str) -> str:
    rh, rt = K.FEEDBACK_ROLE.split("{role}")
    kh, kt = K.FEEDBACK_KEYWORDS.split("{hint}")
    return (f"(CASE {rule} WHEN 'empty_fix' THEN {q(K.FEEDBACK_EMPTY)} "
            f"WHEN 'invalid_step_id' THEN 'REJECTED: fault_step_id=' || {py_str(step)} || ' is out of range [1, ' || "
            f"CAST({n} AS VARCHAR) || ']. Pick a valid step.' "
            f"WHEN 'invalid_role' THEN {q(rh)} || {py_str(role)} || {q(rt)} "
            f"WHEN 'identical_to_corrupt' THEN {q(K.FEEDBACK_IDENTICAL)} "
            f"WHEN 'missing_keywords' THEN {q(kh)} || {hint(kw)} || {q(kt)} END)")


# ---------------------------------------------------------------------------
# Drawn actions / attempts / completions (B4-B6) and the reward log
# ---------------------------------------------------------------------------

ROLES_BAD = K.ROLES + ["Reviewer"]


def drawn_fix(keyc: str, tag: str) -> str:
    return (f"(CASE {draw('5', keyc, q(tag))} WHEN 0 THEN original_output WHEN 1 THEN corrupted_output "
            f"WHEN 2 THEN clean_pipeline[1].output WHEN 3 THEN {q(K.BASELINE_FIX_GRADER)} ELSE '  ' END)")


LI_ACT = f"""
li_act AS (
  SELECT pipeline_id, bank_pos,
         {draw('len(corrupted_pipeline) + 2', 'pipeline_id', q('guess'))} AS fault_step_id,
         {elem(ROLES_BAD, draw('4', 'pipeline_id', q('role')))} AS blame_role,
         {drawn_fix('pipeline_id', 'fix')} AS fix_content,
         {elem(K.ACTION_TYPES, draw('3', 'pipeline_id', q('atype')))} AS action_type
  FROM li_bank
),
li_acted AS (
  SELECT a.*, b.curriculum_level, CAST(len(b.corrupted_pipeline) AS INTEGER) AS n_steps, b.injected_step,
         b.injected_role, b.error_type, b.original_output, b.corrupted_output, b.expected_fix_keywords
  FROM li_act a JOIN li_bank b ON a.pipeline_id = b.pipeline_id
)"""

LI_ATT = f"""
li_att0 AS (
  SELECT *, unnest(range(1, CAST({draw('3', 'pipeline_id', q('n_att'))} + 2 AS BIGINT))) AS attempt_no FROM li_bank
),
li_att1 AS (SELECT *, pipeline_id || '#' || CAST(attempt_no AS VARCHAR) AS akey FROM li_att0),
li_att AS (
  SELECT pipeline_id AS episode_id, CAST(attempt_no AS INTEGER) AS attempt_no,
         {draw('len(corrupted_pipeline)', 'akey', q('guess'))} + 1 AS fault_step_id,
         {elem(ROLES_BAD, draw('4', 'akey', q('role')))} AS blame_role,
         {drawn_fix('akey', 'fix')} AS fix_content,
         {elem(K.ACTION_TYPES, draw('3', 'akey', q('atype')))} AS action_type
  FROM li_att1
)"""


def json_str(x: str) -> str:
    e = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"('\"' || {e} || '\"')"


LI_COMP = f"""
li_comp0 AS (
  SELECT pipeline_id, bank_pos, fault_step_id, blame_role, fix_content, action_type,
         CAST(fault_step_id AS VARCHAR) AS st,
         {draw('6', 'pipeline_id', q('srep'))} AS srep, {draw('5', 'pipeline_id', q('rrep'))} AS rrep,
         {draw('2', 'pipeline_id', q('hasat'))} AS hasat, {draw('5', 'pipeline_id', q('ctext'))} AS kind
  FROM li_act
),
li_comp1 AS (
  SELECT *, '{{"fault_step_id": ' ||
         (CASE srep WHEN 1 THEN '"' || st || '"' WHEN 2 THEN st || '.7' WHEN 3 THEN 'true' WHEN 4 THEN 'null' ELSE st END)
         || ', "blame_role": ' ||
         (CASE rrep WHEN 3 THEN {json_str('lower(blame_role)')} WHEN 4 THEN '7' ELSE {json_str('blame_role')} END)
         || ', "fix_content": ' || {json_str('fix_content')} ||
         (CASE WHEN hasat = 0 THEN ', "action_type": ' || {json_str('action_type')} ELSE '' END) AS body
  FROM li_comp0
),
li_comp AS (
  SELECT pipeline_id, bank_pos,
    CASE kind WHEN 0 THEN body || '}}'
      WHEN 1 THEN 'Step ' || st || {q(' looks wrong.' + chr(10))} || body || {q('}' + chr(10) + 'That is my answer.')}
      WHEN 2 THEN body
      WHEN 3 THEN '{{''fault_step_id'': ' || st || ', ''blame_role'': ''' || blame_role || ''', ''fix_content'': ''see above''}}'
      ELSE 'I could not decide; maybe step ' || st || ' by the ' || lower(blame_role) || '.' END AS text
  FROM li_comp1
)"""

SEP = '["' + WS[1:-1] + ':]+'


def parse_sql(t: str, strict: bool) -> dict:
    raw = f"regexp_extract({t}, {q(chr(92) + '{[^{}]*' + chr(92) + '}')}, 0)"
    ok_json = f"({raw} <> '' AND json_valid({raw}))"
    obj = f"(CASE WHEN {ok_json} THEN {raw} END)"
    keys = f"json_keys({obj})"
    has = lambda k: f"list_contains({keys}, {q(k)})"
    val = "json_extract(" + obj + ", '$.fault_step_id')"
    typ = f"json_type({val})"
    j_step = (f"(CASE {typ} WHEN 'BIGINT' THEN TRY_CAST(json_extract_string({obj}, '$.fault_step_id') AS BIGINT) "
              f"WHEN 'UBIGINT' THEN TRY_CAST(json_extract_string({obj}, '$.fault_step_id') AS BIGINT) "
              f"WHEN 'DOUBLE' THEN TRY_CAST(trunc(CAST(json_extract_string({obj}, '$.fault_step_id') AS DOUBLE)) AS BIGINT) "
              f"WHEN 'VARCHAR' THEN TRY_CAST(trim(json_extract_string({obj}, '$.fault_step_id')) AS BIGINT) "
              f"WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string({obj}, '$.fault_step_id') = 'true' THEN 1 ELSE 0 END END)")
    j_role = f"json_extract_string({obj}, '$.blame_role')"
    j_fix = f"json_extract_string({obj}, '$.fix_content')"
    j_type = f"(CASE WHEN {has('action_type')} THEN json_extract_string({obj}, '$.action_type') ELSE 'submit' END)"
    roles = ", ".join(q(r) for r in K.ROLES)
    json_ok = (f"({ok_json} AND coalesce({has('fault_step_id')} AND {has('blame_role')} AND {has('fix_content')}, false) "
               f"AND {j_step} IS NOT NULL" + (f" AND coalesce({j_role} IN ({roles}), false))" if strict else ")"))
    step_s = f"regexp_extract({t}, {q('fault_step_id' + SEP + '([0-9]+)')}, 1)"
    role_s = f"regexp_extract({t}, {q('blame_role' + SEP + chr(91) + chr(34) + chr(39) + ']?(Researcher|Coder|Analyst)')}, 1)"
    fix_s = f"regexp_extract({t}, {q('(?s)fix_content' + SEP + '[' + chr(34) + chr(39) + '](.+?)[' + chr(34) + chr(39) + ']')}, 1)"
    default_fix = K.PARSE_FIX_STRICT if strict else K.PARSE_FIX_LENIENT
    return {
        "fault_step_id": f"(CASE WHEN {json_ok} THEN {j_step} WHEN {step_s} = '' THEN CAST(1 AS BIGINT) "
                         f"ELSE coalesce(TRY_CAST({step_s} AS BIGINT), -1) END)",
        "blame_role": f"(CASE WHEN {json_ok} THEN {j_role} WHEN {role_s} = '' THEN 'Researcher' ELSE {role_s} END)",
        "fix_content": f"(CASE WHEN {json_ok} THEN {j_fix} WHEN {fix_s} = '' THEN {q(default_fix)} ELSE {fix_s} END)",
        "action_type": f"(CASE WHEN {json_ok} THEN {j_type} ELSE 'submit' END)",
        "parse_path": f"(CASE WHEN {json_ok} THEN 'json' WHEN {step_s} = '' AND {role_s} = '' AND {fix_s} = '' "
                      f"THEN 'default' ELSE 'regex' END)",
    }


EV_LOG = f"""
ev_src AS (SELECT event_id, ts, user_id, user_id % 8 AS run_id FROM events),
ev_num AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS step FROM ev_src),
ev_d AS (
  SELECT *, CAST({draw('4', 'event_id', q('true'))} + 1 AS INTEGER) AS true_step,
         CAST({draw('4', 'event_id', q('pred'))} + 1 AS INTEGER) AS pred_step,
         least(10000, (event_id * 7919) % 4001 + step * 6) AS bp
  FROM ev_num
),
rlog AS (
  SELECT CAST(run_id AS BIGINT) AS run_id, CAST(step AS BIGINT) AS step,
         CAST({draw('3', 'event_id', q('level'))} + 1 AS INTEGER) AS level,
         'ev_' || CAST(event_id AS VARCHAR) AS pipeline_id,
         CASE WHEN pred_step = true_step THEN {D(1.0)} ELSE {D(0.0)} END AS r_loc,
         CASE WHEN {draw('3', 'event_id', q('blame'))} = 0 THEN {D(1.0)} ELSE {D(0.0)} END AS r_blame,
         CAST((event_id * 31) % 10001 AS DOUBLE) / {D(10000.0)} AS r_fix,
         {D(0.2)} AS r_prec,
         CAST(bp AS DOUBLE) / {D(10000.0)} AS r_total,
         pred_step AS predicted_step, true_step,
         {elem(K.ROLES, draw('3', 'event_id', q('prole')))} AS predicted_role,
         {elem(K.ROLES, draw('3', 'event_id', q('trole')))} AS true_role
  FROM ev_d
)"""


def bp(x: str) -> str:
    return f"CAST(floor({x} * {D(10000.0)} + {D(0.5)}) AS BIGINT)"


def un(x: str) -> str:
    """Reward in integer units of 1e-12."""
    return f"CAST(floor({x} * {D(1e12)} + {D(0.5)}) AS BIGINT)"


def un_mean(x: str) -> str:
    return f"(CAST(sum({un(x)}) AS DOUBLE) / CAST(count({x}) AS DOUBLE) / {D(1e12)})"

"""Fault injection (I1-I9) and fix-keyword extraction (K1-K5).

Every injector is a ``Column -> Column`` expression over the step text, so
building episodes is a narrow map over the trace table: no shuffle, no
Python. Randomness is the md5 ``draw`` keyed by ``(seed, pipeline_id, tag)``,
which makes every episode reproducible regardless of partitioning.

"Shuffle the swap list, take the first pair whose key occurs" is expressed
as "among the pairs whose key occurs, take the one with the smallest drawn
priority" - the same distribution, computed per row with array functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import (
    WHOLE_NUMBER,
    draw,
    draw_key,
    element,
    element_at1,
    lit_array,
    replace_first,
    splice_at,
)
from faultlens.operators.banks import match

Pairs = Sequence[tuple[str, str]]


# Tags that key the per-swap priority draw of each injector.
SWAP_TAGS = {
    "wrong_type": "type",
    "factual_error": "fact",
    "off_by_one": "range",
    "logic_inversion": "logic",
    "cascade_dependency": "dep",
}
SWAP_BANKS = {
    "wrong_type": K.TYPE_SWAPS,
    "factual_error": K.FACTUAL_SWAPS,
    "off_by_one": K.RANGE_SWAPS,
    "logic_inversion": K.LOGIC_SWAPS,
    "cascade_dependency": K.DEPENDENCY_SWAPS,
}


PRIO_HEX = 6  # hex digits of priority per swap pair (24 bits: ties ~ 2^-24)
INDEX = 1 << 32  # room for the pair's index below its priority


def perm_hex(seed, pid: Column, tag: str, n_pairs: int) -> Column:
    """Random priorities for ``n_pairs`` swap pairs as one hex string:
    ``md5(seed:pid:tag:0) || md5(seed:pid:tag:1) || ...``; pair ``i`` owns
    hex digits ``[6i, 6i+6)``. One short string per row, reused by every
    pair, keeps the per-pair code tiny."""
    n_md5 = (PRIO_HEX * n_pairs + 31) // 32
    return F.concat(*[F.md5(draw_key(seed, pid, tag, j)) for j in range(n_md5)])


def hit_priority(text: Column, pairs: Pairs, seed, pid: Column, tag: str, ci: bool = False,
                 low: Column | None = None, perm: Column | None = None) -> Column:
    """``priority * INDEX + index`` of the drawn-first pair whose key occurs in
    ``text`` (NULL if none) - "shuffle the list, take the first pair that
    occurs" as "smallest random priority among the pairs that occur".

    Each pair contributes ``CASE WHEN contains(text, find) THEN priority``
    and ``least`` (which skips NULLs) picks the smallest. Plain expressions
    over the literal bank stay inside whole-stage codegen (no lambdas).
    ``low``: an already lower-cased ``text`` (case-insensitive bank);
    ``perm``: the materialized :func:`perm_hex` column.
    """
    hay = (low if low is not None else F.lower(text)) if ci else text
    perm = perm if perm is not None else perm_hex(seed, pid, tag, max(len(pairs), 1))
    prios = [
        F.when(
            F.contains(hay, F.lit(a.lower() if ci else a)),
            F.conv(F.substring(perm, PRIO_HEX * i + 1, PRIO_HEX), 16, 10).cast("bigint") * INDEX + i,
        )
        for i, (a, _) in enumerate(pairs)
    ]
    if not prios:
        return F.lit(None).cast("bigint")
    return F.least(*prios) if len(prios) > 1 else prios[0]


def hit_from_priority(best: Column, pairs: Pairs) -> Column:
    """``STRUCT<find, repl>`` of the pair chosen by :func:`hit_priority`."""
    idx = F.pmod(best, F.lit(INDEX))
    return F.when(
        best.isNotNull(),
        F.struct(element([a for a, _ in pairs], idx).alias("find"), element([b for _, b in pairs], idx).alias("repl")),
    )


def first_hit(text: Column, pairs: Pairs, seed, pid: Column, tag: str, ci: bool = False,
              low: Column | None = None, perm: Column | None = None) -> Column:
    """The drawn-first swap pair that occurs, as ``STRUCT<find, repl>``."""
    return hit_from_priority(hit_priority(text, pairs, seed, pid, tag, ci, low, perm), pairs)


def whole_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WHOLE_NUMBER), 0)


def inject_wrong_type(text: Column, hit: Column) -> Column:
    """First drawn type swap that occurs (case-sensitive), replaced once;
    else the first ``.`` gets a note; no ``.`` leaves the text unchanged."""
    return F.when(hit.isNotNull(), replace_first(text, hit["find"], hit["repl"])).otherwise(
        replace_first(text, ".", K.WRONG_TYPE_NOTE)
    )


def inject_factual_error(text: Column, hit: Column, low: Column | None = None) -> Column:
    """I4: case-insensitive find, spliced at the position found in the
    lower-cased text; else a false claim is appended."""
    low = low if low is not None else F.lower(text)
    pos = F.instr(low, F.lower(hit["find"]))
    return F.when(hit.isNotNull(), splice_at(text, pos, F.length(hit["find"]), hit["repl"])).otherwise(
        F.concat(text, F.lit(K.FACTUAL_FALLBACK))
    )


def inject_off_by_one(text: Column, hit: Column, nums: Column, k: Column, delta: Column) -> Column:
    """One drawn whole number moves by a drawn +-1 (arbitrary size via
    DECIMAL(38,0); leading zeros are lost as with int()); without numbers (no
    drawn ``k``) a drawn range swap, else a boundary note after the first ``.``."""
    known = k.isNotNull()  # there are numbers
    moved_s = F.try_add(nums[k].try_cast("decimal(38,0)"), delta).cast("string")
    pieces = F.split(text, WHOLE_NUMBER, -1)
    new_nums = F.transform(nums, lambda x, i: F.when(i == k, moved_s).otherwise(x))
    rebuilt = F.array_join(F.zip_with(pieces, new_nums, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return (
        F.when(known & moved_s.isNotNull(), rebuilt)
        .when(known, text)  # digit run beyond DECIMAL(38,0): left unchanged
        .when(hit.isNotNull(), replace_first(text, hit["find"], hit["repl"]))
        .otherwise(replace_first(text, ".", K.OFF_BY_ONE_NOTE))
    )


def inject_logic_inversion(text: Column, hit: Column) -> Column:
    """Drawn-first comparison/term swap replaced once; else
    correctly -> incorrectly; else an inversion note is appended."""
    return (
        F.when(hit.isNotNull(), replace_first(text, hit["find"], hit["repl"]))
        .when(F.instr(text, F.lit("correctly")) > 0, replace_first(text, "correctly", "incorrectly"))
        .otherwise(F.concat(text, F.lit(K.LOGIC_FALLBACK)))
    )


def inject_cascade_dependency(text: Column, hit: Column) -> Column:
    """Drawn-first name swap replaced everywhere; else the first
    ``return`` becomes ``yield``; else a marker is appended."""
    return (
        F.when(hit.isNotNull(), F.replace(text, hit["find"], hit["repl"]))
        .when(F.instr(text, F.lit("return")) > 0, replace_first(text, "return", "yield"))
        .otherwise(F.concat(text, F.lit(K.DEPENDENCY_FALLBACK)))
    )


Banks = Mapping[str, Pairs]


def swap_perm(error_type: Column, seed, pid: Column, banks: Banks = SWAP_BANKS) -> Column:
    """:func:`perm_hex` for the swap bank of ``error_type``."""
    return _by_type(error_type, lambda et, pairs: perm_hex(seed, pid, SWAP_TAGS[et], max(len(pairs), 1)), banks)


def _by_type(error_type: Column, make, banks: Banks) -> Column:
    out = None
    for et, pairs in banks.items():
        v = make(et, pairs)
        out = F.when(error_type == et, v) if out is None else out.when(error_type == et, v)
    return out


def swap_priority(error_type: Column, text: Column, seed, pid: Column, low: Column | None = None,
                  perm: Column | None = None, banks: Banks = SWAP_BANKS) -> Column:
    """:func:`hit_priority` over the swap bank of ``error_type``."""
    return _by_type(error_type, lambda et, pairs: hit_priority(
        text, pairs, seed, pid, SWAP_TAGS[et], ci=(et == "factual_error"), low=low, perm=perm), banks)


def swap_hit(error_type: Column, best: Column, banks: Banks = SWAP_BANKS) -> Column:
    """``STRUCT<find, repl>`` for a materialized :func:`swap_priority`."""
    return _by_type(error_type, lambda et, pairs: hit_from_priority(best, pairs), banks)


def inject(error_type: Column, text: Column, hit: Column, low: Column, nums: Column, k: Column,
           delta: Column) -> Column:
    """I8: dispatch by error type (NULL for an unknown type). ``hit`` comes
    from :func:`swap_hit`, ``nums`` are the whole numbers of the text, ``k``
    the drawn number index and ``delta`` the drawn +-1 - all materialized
    columns (see :func:`inject_column`) so each is evaluated once per row."""
    return (
        F.when(error_type == "wrong_type", inject_wrong_type(text, hit))
        .when(error_type == "factual_error", inject_factual_error(text, hit, low))
        .when(error_type == "off_by_one", inject_off_by_one(text, hit, nums, k, delta))
        .when(error_type == "logic_inversion", inject_logic_inversion(text, hit))
        .when(error_type == "cascade_dependency", inject_cascade_dependency(text, hit))
    )


def inject_column(df: DataFrame, error_type: str, text: str, pid: str, out: str, seed: int = 42,
                  keywords_out: str | None = None, swaps: Banks | DataFrame | None = None) -> DataFrame:
    """Inject one fault into ``text`` by ``error_type`` (and optionally
    extract the fix keywords of the clean text) as a narrow map.

    Intermediate columns - the lower-cased text, the priority string, the
    winning priority, the hit and the number list - are materialized in
    their own projections: each is referenced several times downstream, so
    the optimizer keeps them instead of inlining (and re-evaluating) them.
    ``swaps`` replaces the swap banks of some error types: a few hundred pairs as
    lists, any number as a bank table (see ``banks``), which may hold the
    keyword terms too.
    """
    et, t, p = F.col(error_type), F.col(text), F.col(pid)
    from_table = isinstance(swaps, DataFrame)
    banks = {**SWAP_BANKS, **({} if from_table else swaps or {})}
    d = df.withColumn("_low", F.lower(t))
    if from_table:
        d = match(d, swaps, error_type, text, "_low", pid, seed)
    else:
        d = d.withColumn("_perm", swap_perm(et, seed, p, banks))
        d = d.withColumn("_best", swap_priority(et, t, seed, p, F.col("_low"), F.col("_perm"), banks))
        d = d.withColumn("_hit", swap_hit(et, F.col("_best"), banks))
    d = d.withColumn("_nums", F.when(et == "off_by_one", whole_numbers(t))).withColumn(
        "_k", draw(seed, p, "num", n=F.size("_nums"))
    ).withColumn("_delta", _delta(seed, p))
    d = d.withColumn(out, inject(et, t, F.col("_hit"), F.col("_low"), F.col("_nums"), F.col("_k"), F.col("_delta")))
    if keywords_out and from_table:
        d = d.withColumn(keywords_out, keywords_of_terms(et, F.col("_terms"), keywords_numeric(t, F.col("_nums"))))
    elif keywords_out:
        d = d.withColumn(keywords_out, fix_keywords(et, t, F.col("_low"), F.col("_nums"), banks["factual_error"]))
    return d.drop("_low", "_perm", "_best", "_nums", "_hit", "_terms", "_k", "_delta")


def _delta(seed, pid: Column) -> Column:
    return F.when(draw(seed, pid, "sign", n=2) == 0, F.lit(-1)).otherwise(F.lit(1))


TERM_END = "\x1f"


def find_fault(df: DataFrame, error_type: str, text: str, pid: str, seed: int = 42) -> DataFrame:
    """The looked-up half of ``inject_column``, small enough to be stored: ``place`` of the
    winning pair in its swap bank, ``number``, the drawn whole number (NULL without one),
    and ``terms``, the keywords in one string, but for those that are the text's
    numbers. ``form_fault`` makes the texts of them."""
    et, t, p = F.col(error_type), F.col(text), F.col(pid)
    d = df.withColumn("_low", F.lower(t)).withColumn("_perm", swap_perm(et, seed, p))
    d = d.withColumn("_best", swap_priority(et, t, seed, p, F.col("_low"), F.col("_perm")))
    d = d.withColumn("_nums", F.when(et == "off_by_one", whole_numbers(t)))
    terms = F.array_join(fix_keywords(et, t, F.col("_low"), F.col("_nums")), TERM_END)
    return d.withColumns({
        "place": F.pmod(F.col("_best"), F.lit(INDEX)).cast("int"), "number": draw(seed, p, "num", n=F.size("_nums")).cast("int"),
        "terms": F.when(et != "off_by_one", terms),
    }).drop("_low", "_perm", "_best", "_nums")


def form_fault(df: DataFrame, error_type: str, text: str, pid: str, out: str, keywords_out: str, seed: int = 42) -> DataFrame:
    """The texts of what ``find_fault`` found: the rows and columns of ``inject_column``
    without a search in the swap banks."""
    et, t = F.col(error_type), F.col(text)
    d = df.withColumn("_low", F.when(et == "factual_error", F.lower(t))).withColumn("_hit", swap_hit(et, F.col("place").cast("bigint")))
    d = d.withColumn("_nums", F.when(et == "off_by_one", whole_numbers(t)))
    d = d.withColumn(out, inject(et, t, F.col("_hit"), F.col("_low"), F.col("_nums"), F.col("number"), _delta(seed, F.col(pid))))
    words = F.when(et == "off_by_one", keywords_numeric(t, F.col("_nums"))).otherwise(F.split("terms", TERM_END))
    return d.withColumn(keywords_out, words).drop("_low", "_hit", "_nums")


def error_description(error_type: Column, step_id: Column, role: Column) -> Column:
    desc = F.create_map(*[x for kv in K.ERROR_DESCRIPTIONS.items() for x in map(F.lit, kv)])
    return F.concat(desc[error_type], F.lit(" at step "), step_id.cast("string"), F.lit(" ("), role, F.lit(")"))


# ---------------------------------------------------------------------------
# Keywords
# ---------------------------------------------------------------------------


def _present(terms: Sequence[str], text: Column, lower: bool = False) -> Column:
    """The literal terms that occur in ``text``, in list order (terms are
    lower-cased first when ``text`` is)."""
    return F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(t.lower() if lower else t)), F.lit(t)) for t in terms])
    )


def _or_default(found: Column, default: Sequence[str]) -> Column:
    return F.when(F.size(found) > 0, F.slice(found, 1, K.MAX_KEYWORDS)).otherwise(lit_array(default))


def keywords_factual(original: Column, swaps: Pairs = K.FACTUAL_SWAPS, low: Column | None = None) -> Column:
    low = low if low is not None else F.lower(original)
    return _or_default(_present([a for a, _ in swaps], low, lower=True), K.KEYWORDS_FACTUAL_DEFAULT)


def keywords_numeric(original: Column, nums: Column | None = None) -> Column:
    nums = F.slice(nums if nums is not None else whole_numbers(original), 1, 3)
    return F.slice(F.concat(nums, lit_array(K.KEYWORDS_NUMERIC_TAIL)), 1, K.MAX_KEYWORDS)


def keywords_logic(original: Column, low: Column | None = None) -> Column:
    low = low if low is not None else F.lower(original)
    return _or_default(_present(K.LOGIC_TERMS, low, lower=True), K.KEYWORDS_LOGIC_DEFAULT)


def keywords_dependency(original: Column) -> Column:
    return _or_default(_present(K.DEPENDENCY_TERMS, original), K.KEYWORDS_DEPENDENCY_DEFAULT)


def fix_keywords(error_type: Column, original: Column, low: Column | None = None,
                 nums: Column | None = None, factual: Pairs = K.FACTUAL_SWAPS) -> Column:
    """K1-K5 by error type."""
    return (
        F.when(error_type == "wrong_type", lit_array(K.KEYWORDS_WRONG_TYPE))
        .when(error_type == "factual_error", keywords_factual(original, factual, low=low))
        .when(error_type == "off_by_one", keywords_numeric(original, nums))
        .when(error_type == "logic_inversion", keywords_logic(original, low))
        .when(error_type == "cascade_dependency", keywords_dependency(original))
    )


def keywords_of_terms(error_type: Column, found: Column, numeric: Column) -> Column:
    """K1-K5 with the terms already found in the banks of the error types."""
    return (
        F.when(error_type == "wrong_type", lit_array(K.KEYWORDS_WRONG_TYPE))
        .when(error_type == "factual_error", _or_default(found, K.KEYWORDS_FACTUAL_DEFAULT))
        .when(error_type == "off_by_one", numeric)
        .when(error_type == "logic_inversion", _or_default(found, K.KEYWORDS_LOGIC_DEFAULT))
        .when(error_type == "cascade_dependency", _or_default(found, K.KEYWORDS_DEPENDENCY_DEFAULT))
    )


# ---------------------------------------------------------------------------
# Episode assembly
# ---------------------------------------------------------------------------


def choose_error(level: Column, seed, pid: Column) -> Column:
    """Uniform error type among those allowed for the level."""
    by_level = F.create_map(
        *[x for lvl, types in K.ERROR_TYPES_BY_LEVEL.items() for x in (F.lit(lvl), lit_array(types))]
    )
    types = by_level[level]
    return element_at1(types, draw(seed, pid, "error", n=F.size(types)) + 1)


def patch_step(steps: Column, step_id: Column, text: Column) -> Column:
    """P5: replace the output of exactly one step of a nested trace.

    Built with ``slice``/``concat`` around the patched element rather than a
    ``transform`` lambda: a lambda that references ``text`` would inline the
    whole injector expression into every array element."""
    pos = F.array_position(F.transform(steps, lambda s: s["step_id"]), step_id)
    target = F.element_at(steps, pos.cast("int"))
    return F.when(
        pos > 0,
        F.concat(
            F.slice(steps, 1, (pos - 1).cast("int")),
            F.array(target.withField("output", text)),
            F.slice(steps, (pos + 1).cast("int"), F.size(steps)),
        ),
    ).otherwise(steps)


PER_TRACE = 5


def number_episodes(traces: DataFrame, per_trace: int = PER_TRACE, prefix: str = "pipe", numbers: bool = False) -> DataFrame:
    """One row per (trace, k), k in 0..per_trace-1, with ``bank_pos`` and ``pipeline_id``;
    ``numbers`` keeps ``trace_id`` and ``k``."""
    ep = traces.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_trace - 1))))
    pid = F.concat(F.lit(prefix + "_"), F.col("trace_id").cast("string"), F.lit("_err_"), F.col("k").cast("string"))
    ep = ep.withColumns({"bank_pos": F.col("trace_id") * per_trace + F.col("k"), "pipeline_id": pid})
    return ep if numbers else ep.drop("trace_id", "k")


def choose_fault(ep: DataFrame, n_steps: Column, seed: int = 42) -> DataFrame:
    """The drawn step and error type of each episode."""
    pid = F.col("pipeline_id")
    return ep.withColumn("injected_step", (draw(seed, pid, "step", n=n_steps) + 1).cast("int")).withColumn(
        "error_type", choose_error(F.col("curriculum_level"), seed, pid)
    )


def build_episodes(traces: DataFrame, per_trace: int = PER_TRACE, seed: int = 42, prefix: str = "pipe",
                   swaps: Banks | DataFrame | None = None) -> DataFrame:
    """One episode per (trace, k), k in 0..per_trace-1.

    ``traces``: nested form ``trace_id, curriculum_level, task_brief, domain,
    steps ARRAY<STRUCT<step_id, role, output>>`` (see ``traces.nest_steps``).
    A narrow map: the output keeps the trace table's partitioning.
    """
    ep = number_episodes(traces, per_trace, prefix).select(
        "bank_pos", "pipeline_id", "curriculum_level", "task_brief", "domain", F.col("steps").alias("clean_pipeline")
    )
    return inject_episodes(ep, seed, swaps)


def inject_episodes(ep: DataFrame, seed: int = 42, swaps: Banks | DataFrame | None = None) -> DataFrame:
    """Numbered episodes with their clean trace, completed by a fault: a narrow map."""
    ep = choose_fault(ep, F.size("clean_pipeline"), seed)
    target = element_at1(F.col("clean_pipeline"), F.col("injected_step"))
    ep = ep.withColumn("injected_role", target["role"]).withColumn("original_output", target["output"])
    ep = inject_column(ep, "error_type", "original_output", "pipeline_id", "corrupted_output", seed,
                       keywords_out="expected_fix_keywords", swaps=swaps)
    return ep.select(
        "bank_pos",
        "pipeline_id",
        "curriculum_level",
        "task_brief",
        "domain",
        "clean_pipeline",
        patch_step(F.col("clean_pipeline"), F.col("injected_step"), F.col("corrupted_output")).alias(
            "corrupted_pipeline"
        ),
        "injected_step",
        "injected_role",
        "error_type",
        error_description(F.col("error_type"), F.col("injected_step"), F.col("injected_role")).alias(
            "error_description"
        ),
        "original_output",
        "corrupted_output",
        "expected_fix_keywords",
    )

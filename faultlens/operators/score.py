"""Scoring: localization, blame, fix quality, precision, totals (R1-R5) and
role-specific verifiers (F1-F4).

All scores are DOUBLE column expressions evaluated in the same operation
order as the original formulas, so results are bit-identical to a plain
SQL engine doing the same arithmetic. Rounding to 4 decimals is half-up on
``x * 10000`` (see ``round4``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import is_blank, keyword_hits, lit_array, round4, safe_size, tokens, utrim
from faultlens.operators.traces import kept_words

D = F.lit  # DOUBLE literal helper: Python floats become DOUBLE literals


def score_localization(pred: Column, true: Column, level: Column) -> Column:
    """1 exact; 0.3 at level 1 when off by one; else 0."""
    return (
        F.when(pred == true, D(1.0))
        .when((level == 1) & (F.abs(pred - true) == 1), D(0.3))
        .otherwise(D(0.0))
    )


def score_blame(pred: Column, true: Column) -> Column:
    """R2: exact role match."""
    return F.when(pred == true, D(1.0)).otherwise(D(0.0))


def keyword_share(fix: Column, keywords: Column, empty: float = 0.5, low: Column | None = None) -> Column:
    """Share of keywords found (case-insensitive); ``empty`` when none."""
    n = safe_size(keywords)
    return F.when(n > 0, keyword_hits(fix, keywords, low).cast("double") / n.cast("double")).otherwise(D(empty))


def not_corrupt(fix: Column, corrupted: Column, low: Column | None = None) -> Column:
    """0 when the fix equals the corrupted text ignoring case (no trim)."""
    c = F.coalesce(corrupted, F.lit(""))
    return F.when((c != "") & ((low if low is not None else F.lower(fix)) == F.lower(c)), D(0.0)).otherwise(D(1.0))


def length_fit(fix: Column, original: Column) -> Column:
    """1 for a length ratio in [0.3, 3]; linear penalties outside;
    0.5 without an original."""
    o = F.coalesce(original, F.lit(""))
    r = F.length(fix).cast("double") / F.length(o).cast("double")
    return (
        F.when(o == "", D(0.5))
        .when((r >= 0.3) & (r <= 3.0), D(1.0))
        .when(r < 0.3, r / D(0.3))
        .otherwise(F.greatest(D(0.0), D(1.0) - (r - D(3.0)) / D(7.0)))
    )


def distinct_words(original: Column) -> Column:
    """Distinct lower-cased whitespace tokens of an original text."""
    return F.array_distinct(tokens(F.lower(F.coalesce(original, F.lit("")))))


def word_overlap(fix: Column, original: Column, low: Column | None = None, words: Column | None = None) -> Column:
    """R3d: distinct whitespace tokens of the original found in the fix,
    over distinct tokens of the original (hash-based set intersection). ``words``:
    the original's, if kept with the bank."""
    ow = words if words is not None else distinct_words(original)
    fw = tokens(low if low is not None else F.lower(fix))
    n = F.size(ow)
    return F.when(n > 0, F.size(F.array_intersect(ow, fw)).cast("double") / n.cast("double")).otherwise(D(0.0))


def score_fix(fix: Column, original: Column, keywords: Column, corrupted: Column, rounded: bool = True,
              low: Column | None = None, words: Column | None = None) -> Column:
    """R3 (server, rounded) / R3t (training, unrounded): weighted sum of
    R3a-R3d clipped to [0, 1]; 0 for a NULL or blank fix."""
    parts = keyword_share(fix, keywords, low=low), not_corrupt(fix, corrupted, low), length_fit(fix, original), word_overlap(fix, original, low, words)
    return weighted_fix(fix, *parts, rounded)


def weighted_fix(fix: Column, keyword: Column, differs: Column, length: Column, overlap: Column, rounded: bool = True) -> Column:
    """:func:`score_fix` of R3a-R3d."""
    total = D(K.FIX_W_KEYWORD) * keyword + D(K.FIX_W_NOT_CORRUPT) * differs + D(K.FIX_W_LENGTH) * length + D(K.FIX_W_OVERLAP) * overlap
    clipped = F.least(F.greatest(total, D(0.0)), D(1.0))
    value = round4(clipped) if rounded else clipped
    return F.when(is_blank(fix), D(0.0)).otherwise(value)


def score_fix_simple(fix: Column, keywords: Column, empty: float = 0.3, blank_zero: bool = True, low: Column | None = None) -> Column:
    """R3g (grader: blank -> 0, no keywords -> 0.3) and R3i (inference:
    share over max(n, 1), no blank check, no keywords -> 0)."""
    share = keyword_share(fix, keywords, empty=empty, low=low)
    return F.when(is_blank(fix), D(0.0)).otherwise(share) if blank_zero else share


def score_precision(turn: Column, accepted: Column, max_turns: int | None = K.MAX_TURNS) -> Column:
    """Accepted at turn 1 -> 1.0, later -> 0.6; not accepted -> 0.2;
    beyond ``max_turns`` -> 0 (``None`` drops that rule, as the trainers do)."""
    acc = F.coalesce(accepted, F.lit(False))
    base = F.when(acc & (turn == 1), D(1.0)).when(acc, D(0.6)).otherwise(D(0.2))
    return base if max_turns is None else F.when(turn > max_turns, D(0.0)).otherwise(base)


def weighted_total(r1: Column, r2: Column, r3: Column, r4: Column) -> Column:
    return D(K.W_LOCALIZATION) * r1 + D(K.W_BLAME) * r2 + D(K.W_FIX) * r3 + D(K.W_PRECISION) * r4


def score_total(
    df: DataFrame,
    variant: str = "server",
    level_col: str = "curriculum_level",
    turn: Column | None = None,
    accepted: Column | None = None,
) -> DataFrame:
    """Add ``localization, blame, fix, precision, total``.

    Expects action columns (``fault_step_id, blame_role, fix_content``) and
    truth columns (``injected_step, injected_role, original_output,
    corrupted_output, expected_fix_keywords``) on the same row.

    variant: ``server`` (fix and total rounded, precision by turn/gate),
    ``train`` (unrounded, precision 0.2), ``grade`` (keyword-only fix with
    0.3 for no keywords, precision 0.5), ``infer`` (keyword-only fix over
    max(n,1), precision 0.2, total rounded).
    """
    pred, true = F.col("fault_step_id"), F.col("injected_step")
    r1 = score_localization(pred, true, F.col(level_col))
    r2 = score_blame(F.col("blame_role"), F.col("injected_role"))
    fix, kw, low = F.col("fix_content"), F.col("expected_fix_keywords"), F.col("_fix_low")
    words = F.col("original_words") if kept_words(df) else None
    if variant == "server":
        r3 = score_fix(fix, F.col("original_output"), kw, F.col("corrupted_output"), True, low, words)
        r4 = score_precision(turn if turn is not None else F.lit(1), accepted if accepted is not None else F.lit(False))
    elif variant == "train":
        r3 = score_fix(fix, F.col("original_output"), kw, F.col("corrupted_output"), False, low, words)
        r4 = D(0.2)
    elif variant == "grade":
        r3 = score_fix_simple(fix, kw, empty=0.3, blank_zero=True, low=low)
        r4 = D(K.GRADER_PRECISION)
    elif variant == "infer":
        r3 = score_fix_simple(fix, kw, empty=0.0, blank_zero=False, low=low)
        r4 = D(K.INFERENCE_PRECISION)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    # lower-cased once in a projection of its own, not once a keyword
    out = df.withColumn("_fix_low", F.lower(F.coalesce(fix, F.lit(""))))
    out = out.withColumn("localization", r1).withColumn("blame", r2).withColumn("fix", r3).withColumn("precision", r4).drop("_fix_low")
    total = weighted_total(F.col("localization"), F.col("blame"), F.col("fix"), F.col("precision"))
    if variant in ("server", "infer"):
        total = round4(total)
    return out.withColumn("total", total)


# ---------------------------------------------------------------------------
# Role verifiers
#
# ``low`` is the lower-cased fix and ``words`` its number of words, where columns
# hold them: a long fix is then lowered and split once, not once a term.
# ---------------------------------------------------------------------------


def _any_in(text: Column, terms) -> Column:
    return F.exists(lit_array(terms), lambda t: F.contains(text, t))


def _count_in(text: Column, terms) -> Column:
    return F.size(F.filter(lit_array(terms), lambda t: F.contains(text, t)))


def _kw_part(fix: Column, keywords: Column, weight: float, low: Column | None = None) -> Column:
    n = safe_size(keywords)
    return F.when(n > 0, D(weight) * (keyword_hits(fix, keywords, low).cast("double") / n.cast("double"))).otherwise(D(0.0))


def verify_researcher(fix: Column, keywords: Column, low: Column | None = None, words: Column | None = None) -> Column:
    """.6 keyword share + .2 explanation word + length (.2 for 10-200
    words, .1 above 5 words otherwise)."""
    part = _kw_part(fix, keywords, 0.6, low)
    low = low if low is not None else F.lower(fix)
    words = words if words is not None else F.size(tokens(fix))
    s = (
        part
        + F.when(_any_in(low, K.EXPLANATION_INDICATORS), D(0.2)).otherwise(D(0.0))
        + F.when((words >= 10) & (words <= 200), D(0.2)).when(words > 5, D(0.1)).otherwise(D(0.0))
    )
    return F.least(s, D(1.0))


def verify_coder(fix: Column, keywords: Column, low: Column | None = None) -> Column:
    """.5 share + .3 * min(indicators/3, 1) (case-sensitive) + .2 for
    2-50 lines of the stripped text, .1 for one line over 20 characters."""
    lines = F.size(F.split(utrim(fix), "\n", -1))
    code = F.least(_count_in(fix, K.CODE_INDICATORS).cast("double") / D(3.0), D(1.0))
    s = (
        _kw_part(fix, keywords, 0.5, low)
        + D(0.3) * code
        + F.when((lines >= 2) & (lines <= 50), D(0.2))
        .when((lines == 1) & (F.length(fix) > 20), D(0.1))
        .otherwise(D(0.0))
    )
    return F.least(s, D(1.0))


def verify_analyst(fix: Column, keywords: Column, low: Column | None = None) -> Column:
    """.5 share + .3 for a number and a quantitative term (.15 for one
    of them) + .2 when at least two of ``. : , ;`` occur."""
    part = _kw_part(fix, keywords, 0.5, low)
    low = low if low is not None else F.lower(fix)
    has_num = fix.rlike(r"[0-9]")
    has_term = _any_in(low, K.QUANT_TERMS)
    s = (
        part
        + F.when(has_num & has_term, D(0.3)).when(has_num | has_term, D(0.15)).otherwise(D(0.0))
        + F.when(_count_in(fix, K.REPORT_INDICATORS) >= 2, D(0.2)).otherwise(D(0.0))
    )
    return F.least(s, D(1.0))


def verify_fix(role: Column, fix: Column, keywords: Column, low: Column | None = None, words: Column | None = None) -> Column:
    """route by role; unknown roles get the plain keyword share (0 when
    there are no keywords); a blank fix scores 0 everywhere."""
    n = safe_size(keywords)
    generic = F.when(n > 0, keyword_hits(fix, keywords, low).cast("double") / n.cast("double")).otherwise(D(0.0))
    routed = (
        F.when(role == "Researcher", verify_researcher(fix, keywords, low, words))
        .when(role == "Coder", verify_coder(fix, keywords, low))
        .when(role == "Analyst", verify_analyst(fix, keywords, low))
        .otherwise(generic)
    )
    return F.when(is_blank(fix), D(0.0)).otherwise(routed)

"""Goldens for scoring, gate and text helpers on the FIXTURES edge rows.

The plain-Python reference functions below are written from the
"""

import pytest
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import is_blank, replace_first, tokens, utrim
from faultlens.operators import gate as V
from faultlens.operators import score as R


def py_fix(fix, original, keywords, corrupted):
    if not fix or not fix.strip():
        return 0.0
    fl = fix.lower()
    kw = sum(1 for k in keywords if k.lower() in fl) / len(keywords) if keywords else 0.5
    nc = 0.0 if (corrupted and fl == corrupted.lower()) else 1.0
    if original:
        r = len(fix) / len(original)
        ln = 1.0 if 0.3 <= r <= 3.0 else (r / 0.3 if r < 0.3 else max(0.0, 1.0 - (r - 3.0) / 7.0))
        ow = set(original.lower().split())
        ov = len(ow & set(fl.split())) / len(ow) if ow else 0.0
    else:
        ln, ov = 0.5, 0.0
    return min(max(0.5 * kw + 0.2 * nc + 0.15 * ln + 0.15 * ov, 0.0), 1.0)


FIX_CASES = [
    (None, "orig text", ["a"], "c"),
    ("", "orig text", ["a"], "c"),
    ("  ", "orig text", ["a"], "c"),
    ("\t\n", "orig text", ["a"], "c"),
    (" ", "orig text", ["a"], "c"),
    ("fix words here", "orig text", [], "c"),
    ("fix", "", ["fix"], "c"),
    ("fix", "orig", ["fix"], ""),
    ("abc", "abcdefghij", ["abc"], "zzz"),          # ratio exactly 0.3
    ("a" * 30, "abcdefghij", ["a"], "zzz"),         # ratio exactly 3.0
    ("a" * 100, "abcdefghij", ["a"], "zzz"),        # ratio 10 -> 0
    ("The Corrupted", "orig", ["x"], "the corrupted"),
    ("The Corrupted ", "orig", ["x"], "the corrupted"),
    ("sorted ascending data", "data is sorted in ascending order", ["ascending", "max", "DATA"], "x"),
]


def test_fix_score_matches_python(spark):
    df = spark.createDataFrame(FIX_CASES, "fix string, o string, kw array<string>, c string")
    got = df.select(R.score_fix(F.col("fix"), F.col("o"), F.col("kw"), F.col("c"), rounded=False).alias("s")).collect()
    for (fix, o, kw, c), row in zip(FIX_CASES, got):
        assert row.s == pytest.approx(py_fix(fix, o, kw, c), abs=1e-12), (fix, o, kw, c)


def test_localization_precision_totals(spark):
    rows = [(2, 2, 1), (1, 2, 1), (1, 2, 2), (1, 3, 1)]
    df = spark.createDataFrame(rows, "p int, t int, l int")
    got = [r.s for r in df.select(R.score_localization(F.col("p"), F.col("t"), F.col("l")).alias("s")).collect()]
    assert got == [1.0, 0.3, 0.0, 0.0]
    pr = spark.createDataFrame([(1, True), (2, True), (1, False), (3, True)], "turn int, acc boolean")
    got = [r.s for r in pr.select(R.score_precision(F.col("turn"), F.col("acc")).alias("s")).collect()]
    assert got == [1.0, 0.6, 0.2, 0.0]
    # all exact + accepted at turn 1 + fix = original with every keyword -> 1.0; via submit -> 0.92
    one = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 0.2)], "a double, b double, c double, d double")
    tot = [r.t for r in one.select(R.weighted_total(*[F.col(c) for c in "abcd"]).alias("t")).collect()]
    assert tot[0] == pytest.approx(1.0) and tot[1] == pytest.approx(0.92)


def test_text_helpers_match_python(spark):
    samples = ["  a b  ", " x ", "\x1cy\x1f", "a b\nc", "", "tab\tsep"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(utrim(F.col("s")).alias("t"), tokens(F.col("s")).alias("k"), is_blank(F.col("s")).alias("b")).collect()
    for s, r in zip(samples, got):
        assert r.t == s.strip()
        assert r.k == s.split()
        assert r.b == (not s or not s.strip())
    r = spark.range(1).select(replace_first(F.lit("a.b.c"), ".", "!").alias("x")).first()
    assert r.x == "a.b.c".replace(".", "!", 1)


GATE_ROWS = [
    # step, role, fix, n, corrupted, keywords, expected rule
    (1, "Coder", "  ", 3, "c", ["k"], "empty_fix"),
    (0, "Coder", "fix", 3, "c", ["k"], "invalid_step_id"),
    (4, "Coder", "fix", 3, "c", ["k"], "invalid_step_id"),
    (1, "Tester", "fix", 3, "c", ["k"], "invalid_role"),
    (1, "Coder", " The Same ", 3, "the same", ["k"], "identical_to_corrupt"),
    (1, "Coder", "nothing here", 3, "c", ["O(n log n)"], "missing_keywords"),
    (1, "Coder", "nothing here", 3, "c", [], None),
    (1, "Coder", "uses boundary", 3, "c", ["boundary", "range"], None),
    (9, "Tester", "", 3, "c", [], "empty_fix"),  # several broken: first wins
]


def test_gate_rules_and_feedback(spark):
    df = spark.createDataFrame(
        GATE_ROWS, "fault_step_id int, blame_role string, fix_content string, n_steps int, corrupted_output string, "
                   "expected_fix_keywords array<string>, want string")
    got = V.gate(df).collect()
    for r in got:
        assert r.violated_rule == r.want
        assert r.accepted == (r.want is None)
    fb = {r.violated_rule: r.feedback for r in got if r.violated_rule}
    assert fb["invalid_step_id"] in ("REJECTED: fault_step_id=0 is out of range [1, 3]. Pick a valid step.",
                                     "REJECTED: fault_step_id=4 is out of range [1, 3]. Pick a valid step.")
    assert fb["invalid_role"] == "REJECTED: blame_role='Tester' is not valid. Choose from: ['Analyst', 'Coder', 'Researcher']."
    assert fb["missing_keywords"] == "REJECTED: Fix does not address the core issue. Focus on complexity analysis."


def test_hint_order(spark):
    cases = [(["x range", "return"], "boundary handling"), (["returns"], "return value"), (["zzz"], K.HINT_DEFAULT),
             (["Correctness", "sorted"], "sorting correctness")]
    df = spark.createDataFrame([(k,) for k, _ in cases], "kw array<string>")
    got = [r.h for r in df.select(V.hint_area(F.col("kw")).alias("h")).collect()]
    assert got == [h for _, h in cases]

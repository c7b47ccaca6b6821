"""Parser and injector edge rows."""

from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.operators.actions import parse_actions
from faultlens.operators.inject import inject_column

PARSE = [
    ('{"fault_step_id": 2, "blame_role": "Coder", "fix_content": "x"}', 2, "Coder", "x", "submit", "json"),
    ('Answer: {"fault_step_id": "3", "blame_role": "Analyst", "fix_content": "y", "action_type": "propose"} ok',
     3, "Analyst", "y", "propose", "json"),
    ('{"fault_step_id": 2.7, "blame_role": "Coder", "fix_content": "z"}', 2, "Coder", "z", "submit", "json"),
    ('{"fault_step_id": true, "blame_role": "Coder", "fix_content": "z"}', 1, "Coder", "z", "submit", "json"),
    ('{"fault_step_id": null, "blame_role": "Coder", "fix_content": "z"}', 1, "Coder", "z", "submit", "regex"),
    ('{"fault_step_id": 4, "blame_role": "coder", "fix_content": "w"}', 4, "Researcher", "w", "submit", "regex"),
    ("{'fault_step_id': 2, 'blame_role': 'Coder'}", 1, "Researcher", K.PARSE_FIX_STRICT, "submit", "default"),
    ('garbage', 1, "Researcher", K.PARSE_FIX_STRICT, "submit", "default"),
    ('fault_step_id: 99999999999999999999999 blame_role: Analyst', -1, "Analyst", K.PARSE_FIX_STRICT, "submit", "regex"),
]


def test_parse_strict(spark):
    df = spark.createDataFrame([(t,) for t, *_ in PARSE], "text string")
    got = parse_actions(df, "text", strict=True).collect()
    for (t, step, role, fix, at, path), r in zip(PARSE, got):
        assert (r.fault_step_id, r.blame_role, r.fix_content, r.action_type, r.parse_path) == (step, role, fix, at, path), t


def test_parse_lenient_keeps_invalid_role(spark):
    df = spark.createDataFrame([('{"fault_step_id": 4, "blame_role": "coder", "fix_content": "w"}',)], "text string")
    r = parse_actions(df, "text", strict=False).first()
    assert (r.fault_step_id, r.blame_role, r.parse_path) == (4, "coder", "json")


INJECT = [
    ("wrong_type", "x = int(y)", "x = str(y)"),
    ("wrong_type", "no key here. end", "no key here" + K.WRONG_TYPE_NOTE + " end"),
    ("wrong_type", "no key no dot", "no key no dot"),
    ("factual_error", "Uses DIVIDE-AND-CONQUER splitting", "Uses brute force splitting"),
    ("factual_error", "plain", "plain" + K.FACTUAL_FALLBACK),
    ("logic_inversion", "pick the highest", "pick the lowest"),
    ("logic_inversion", "it correctly works", "it incorrectly works"),
    ("logic_inversion", "nothing", "nothing" + K.LOGIC_FALLBACK),
    ("cascade_dependency", "results and more results", "temp_data and more temp_data"),
    ("cascade_dependency", "please return it", "please yield it"),
    ("off_by_one", "no numbers; x <= n", "no numbers; x < n"),
    ("off_by_one", "no numbers. here", "no numbers" + K.OFF_BY_ONE_NOTE + " here"),
]


def test_injectors(spark):
    df = spark.createDataFrame([(e, t, f"p{i}") for i, (e, t, _) in enumerate(INJECT)], "et string, t string, pid string")
    got = inject_column(df, "et", "t", "pid", "out").orderBy("pid").collect()
    got = {r.pid: r.out for r in got}
    for i, (_, _, want) in enumerate(INJECT):
        assert got[f"p{i}"] == want, INJECT[i]


def test_off_by_one_numbers(spark):
    texts = ["take 007 now", "zero 0 here", "id_12 and 5", "n" + "9" * 30 + " end"]
    df = spark.createDataFrame([("off_by_one", t, f"q{i}") for i, t in enumerate(texts)], "et string, t string, pid string")
    got = {r.pid: r.out for r in inject_column(df, "et", "t", "pid", "out", keywords_out="kw").collect()}
    assert got["q0"] in ("take 6 now", "take 8 now")
    assert got["q1"] in ("zero -1 here", "zero 1 here")
    assert got["q2"] in ("id_12 and 4", "id_12 and 6")      # id_12 is not a whole number
    assert got["q3"] == texts[3]                             # attached to a letter: no whole number -> no dot -> unchanged

"""Fixed values written out by hand, so that a wrong one is seen: the oracle shares the constants."""

from faultlens.functions import constants as K


def test_weights_and_limits():
    assert (K.W_LOCALIZATION, K.W_BLAME, K.W_FIX, K.W_PRECISION) == (0.35, 0.20, 0.35, 0.10)
    assert (K.MAX_TURNS, K.MAX_KEYWORDS, K.GRADER_PRECISION, K.GRADER_FALLBACK_TOTAL) == (2, 5, 0.5, 0.05)
    assert K.CURRICULUM_THRESHOLDS[1] == 0.4 and K.CURRICULUM_THRESHOLDS[2] == 0.6
    assert K.TARGET_MEAN_BY_LEVEL == {1: 0.4, 2: 0.6, 3: 0.7} and K.GRADER_SEEDS == {1: 42, 2: 43, 3: 44}


def test_names():
    assert K.ROLES == ["Researcher", "Coder", "Analyst"]
    assert sorted(K.ACTION_TYPES) == ["propose", "revise", "submit"]
    assert K.BASELINE_FIX_GRADER == "This is a placeholder fix from the baseline agent."
    assert {t for types in K.ERROR_TYPES_BY_LEVEL.values() for t in types} == {
        "wrong_type", "factual_error", "off_by_one", "logic_inversion", "cascade_dependency",
    }

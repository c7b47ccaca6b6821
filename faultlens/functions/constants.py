"""Fixed values.

Everything in this module must equal the values of the original
environment for results to match: role names, curriculum rules, swap and
term banks, feedback strings, verifier word lists, reward weights and
default texts. They are stated plainly and in their original order; the
operators in this package only read them (swap banks are also accepted as
parameters so callers can pass their own).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — roles, curriculum, targets
# ---------------------------------------------------------------------------

ROLES = ["Researcher", "Coder", "Analyst"]

ERROR_TYPES_BY_LEVEL = {
    1: ["wrong_type", "factual_error"],
    2: ["off_by_one", "logic_inversion"],
    3: ["cascade_dependency"],
}

CURRICULUM_THRESHOLDS = {1: 0.4, 2: 0.6}

TARGET_MEAN_BY_LEVEL = {1: 0.4, 2: 0.6, 3: 0.7}

GRADER_SEEDS = {1: 42, 2: 43, 3: 44}

MAX_TURNS = 2

DOMAINS = [
    "algorithm_analysis",
    "data_processing",
    "api_design",
    "database_query",
    "ml_pipeline",
    "text_processing",
    "math_statistics",
    "web_scraping",
    "file_system",
    "security",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — reward weights
# ---------------------------------------------------------------------------

W_LOCALIZATION = 0.35
W_BLAME = 0.20
W_FIX = 0.35
W_PRECISION = 0.10

FIX_W_KEYWORD = 0.50
FIX_W_NOT_CORRUPT = 0.20
FIX_W_LENGTH = 0.15
FIX_W_OVERLAP = 0.15

# ---------------------------------------------------------------------------
# FIXED VALUES — injector descriptions
# ---------------------------------------------------------------------------

ERROR_DESCRIPTIONS = {
    "wrong_type": "Changed return type or data format to incorrect type",
    "factual_error": "Introduced a clearly wrong factual claim",
    "off_by_one": "Introduced an off-by-one numerical error",
    "logic_inversion": "Inverted a comparison or logical condition",
    "cascade_dependency": "Changed a variable or reference that downstream steps depend on",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — swap banks (find, replace), in their original order
# ---------------------------------------------------------------------------

FACTUAL_SWAPS = [
    ("O(n log n)", "O(n^2)"),
    ("O(log n)", "O(n)"),
    ("O(1) amortized", "O(n)"),
    ("O(V + E)", "O(V * E)"),
    ("O(n)", "O(1)"),
    ("normal distribution", "uniform distribution"),
    ("statistically significant", "not statistically significant"),
    ("foreign key joins", "cross joins without filtering"),
    ("UTF-8", "ASCII-only"),
    ("parameterized queries", "string concatenation"),
    ("divide-and-conquer", "brute force"),
    ("logarithmic", "linear"),
    ("memoized", "non-memoized"),
    ("sorted input", "unsorted input"),
    ("0-based indexing", "1-based indexing"),
    ("stable sort", "unstable sort"),
    ("correctly handles", "fails to handle"),
    ("success", "failure"),
    ("true", "false"),
    ("ascending", "descending"),
]

TYPE_SWAPS = [
    ("return results", "return str(results)"),
    ("return dict(", "return list("),
    ("return model", 'return "model_placeholder"'),
    ("return items", "return len(items)"),
    ("return sorted(", "return ''.join("),
    ("float(", "str("),
    ("int(", "str("),
]

RANGE_SWAPS = [
    ("range(1, n+1)", "range(1, n)"),
    ("range(0, n)", "range(0, n-1)"),
    ("<= n", "< n"),
    (">= 0", "> 0"),
    ("n - 1", "n"),
    ("n + 1", "n"),
    ("len(arr) - 1", "len(arr)"),
]

LOGIC_SWAPS = [
    ("DESC", "ASC"),
    ("ASC", "DESC"),
    (">", "<"),
    (">=", "<="),
    ("<=", ">="),
    ("<", ">"),
    ("True", "False"),
    ("true", "false"),
    ("ascending", "descending"),
    ("descending", "ascending"),
    ("max", "min"),
    ("min", "max"),
    ("top", "bottom"),
    ("highest", "lowest"),
    ("lowest", "highest"),
    ("increase", "decrease"),
]

DEPENDENCY_SWAPS = [
    ("results", "temp_data"),
    ("model", "classifier_v2"),
    ("data", "raw_input"),
    ("output", "intermediate"),
    ("total", "subtotal"),
    ("user_id", "account_id"),
    ("mean", "median"),
    ("accuracy", "precision"),
    ("score", "rating"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — injector fallback texts
# ---------------------------------------------------------------------------

WRONG_TYPE_NOTE = ". [NOTE: returns string instead of expected dict]."
FACTUAL_FALLBACK = " Note: this algorithm has O(1) time complexity for all inputs."
OFF_BY_ONE_NOTE = ". (Note: boundary is inclusive, not exclusive)."
LOGIC_FALLBACK = " (result is inverted)"
DEPENDENCY_FALLBACK = " [variable_name_changed]"

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword extraction
# ---------------------------------------------------------------------------

KEYWORDS_WRONG_TYPE = ["correct type", "proper format", "expected return"]
KEYWORDS_FACTUAL_DEFAULT = ["correct", "accurate", "verified"]
KEYWORDS_NUMERIC_TAIL = ["boundary", "range", "inclusive"]
LOGIC_TERMS = ["ascending", "descending", "greater", "less", "max", "min", "top", "true", "false"]
KEYWORDS_LOGIC_DEFAULT = ["correct comparison", "proper ordering"]
DEPENDENCY_TERMS = ["results", "model", "data", "output", "total", "return", "score"]
KEYWORDS_DEPENDENCY_DEFAULT = ["consistent naming", "matching variables"]
MAX_KEYWORDS = 5

# ---------------------------------------------------------------------------
# FIXED VALUES — gatekeeper
# ---------------------------------------------------------------------------

FEEDBACK_EMPTY = "REJECTED: Fix content is empty. Provide a substantive correction."
FEEDBACK_STEP = "REJECTED: fault_step_id={step} is out of range [1, {n}]. Pick a valid step."
FEEDBACK_ROLE = "REJECTED: blame_role='{role}' is not valid. Choose from: ['Analyst', 'Coder', 'Researcher']."
FEEDBACK_IDENTICAL = (
    "REJECTED: Your fix is identical to the current (corrupted) output. Provide actual corrections."
)
FEEDBACK_KEYWORDS = "REJECTED: Fix does not address the core issue. Focus on {hint}."

HINT_AREAS = [
    ("O(", "complexity analysis"),
    ("range", "boundary handling"),
    ("sort", "sorting correctness"),
    ("return", "return value"),
    ("correct", "accuracy"),
]
HINT_DEFAULT = "the domain-specific correction"

# ---------------------------------------------------------------------------
# FIXED VALUES — role verifiers
# ---------------------------------------------------------------------------

EXPLANATION_INDICATORS = [
    "because", "therefore", "since", "this means",
    "which", "so that", "due to", "as a result",
    "complexity", "approach", "strategy", "analysis",
]

CODE_INDICATORS = [
    "def ", "return ", "import ", "class ",
    "for ", "while ", "if ", "else:",
    "=", "(", ")", ":", "->",
    "SELECT", "FROM", "WHERE", "JOIN",
]

QUANT_TERMS = ["accuracy", "score", "result", "test", "validated", "verified", "performance", "p-value"]

REPORT_INDICATORS = [".", ":", ",", ";"]

# ---------------------------------------------------------------------------
# FIXED VALUES — answer parsing and baseline agents
# ---------------------------------------------------------------------------

PARSE_FIX_LENIENT = "Unable to parse fix"
PARSE_FIX_STRICT = "default fix"
ACTION_TYPES = ["propose", "revise", "submit"]

BASELINE_FIX_GRADER = "This is a placeholder fix from the baseline agent."
BASELINE_FIX_OFFLINE = "Baseline fix placeholder."

GRADER_PRECISION = 0.5
INFERENCE_PRECISION = 0.2
GRADER_FALLBACK_TOTAL = 0.05

# ---------------------------------------------------------------------------
# FIXED VALUES — prompt rendering
# ---------------------------------------------------------------------------

PROMPT_USER_LENIENT = (
    "Task: {brief}\n\nPipeline output (one step contains a silent error):\n{steps}\n"
    "Find the faulty step, identify the responsible role, and provide the corrected output as JSON."
)
PROMPT_USER_COMPACT = (
    "Task: {brief}\n\nPipeline output (one step has a silent error):\n{steps}\n"
    "Find the faulty step and provide the corrected output as JSON."
)

# The assistant name is a parameter ({name}); the two wordings differ as in
# the two training set-ups they come from.
SYSTEM_PROMPT_LENIENT = (
    "You are {name}, an expert at finding and fixing errors in multi-step AI pipelines.\n\n"
    "You will see a pipeline of steps, each produced by a different role (Researcher, Coder, or Analyst). \n"
    "Exactly ONE step contains a silent error that was injected. Your job is to:\n"
    "1. Identify which step has the error (fault_step_id)\n"
    "2. Identify which role produced it (blame_role)\n"
    "3. Provide the corrected output (fix_content)\n\n"
    "Respond ONLY with a valid JSON object:\n"
    '{{"fault_step_id": <int>, "blame_role": "<Researcher|Coder|Analyst>", '
    '"fix_content": "<corrected output>", "action_type": "submit"}}'
)
SYSTEM_PROMPT_COMPACT = (
    "You are {name}, an expert at finding and fixing errors in multi-step AI pipelines.\n\n"
    "You will see a pipeline of steps, each produced by a different role (Researcher, Coder, or Analyst).\n"
    "Exactly ONE step contains a silent error. Your job:\n"
    "1. Identify which step has the error (fault_step_id)\n"
    "2. Identify which role produced it (blame_role)\n"
    "3. Provide the corrected output (fix_content)\n\n"
    "Respond ONLY with valid JSON:\n"
    '{{"fault_step_id": <int>, "blame_role": "<Researcher|Coder|Analyst>", '
    '"fix_content": "<corrected output>", "action_type": "submit"}}'
)
DEFAULT_AGENT_NAME = "PipelineDebugger"

# ---------------------------------------------------------------------------
# FIXED VALUES — evaluation log lines
# ---------------------------------------------------------------------------

DEFAULT_ENV_NAME = "faultlens"

# Fields every episode must carry (``domain`` is optional).
REQUIRED_FIELDS = [
    "pipeline_id", "curriculum_level", "task_brief", "clean_pipeline",
    "corrupted_pipeline", "injected_step", "injected_role", "error_type",
    "error_description", "original_output", "corrupted_output", "expected_fix_keywords",
]

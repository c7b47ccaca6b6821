"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The
ledger holds, per blob, the rule versions it was scanned with and the spans
found. A scan takes one version per blob that lacks some rule version, runs
only the missing rules on it, and writes a new ledger; findings are joined
back to all paths by blob. A blob that a third of all paths share is scanned
once, and its paths meet it in a join that adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match counts if group
    ``group`` has ``least`` code points or more. ``hint`` is a cheaper pattern that
    occurs in every text with a match. A changed rule needs a new ``version``."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules, then further ones of this scanner, in span order.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    # runs of under 24 cannot count, and longer ones are taken from their start
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
    # from BEGIN to END; without one, to the end of the headers and base64 lines
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
        r"(?:[\x20\t\r\n]*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n){0,9}[^-]*-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:[\x20\t\r\n]*(?:Proc-Type|DEK-Info|Comment|Subject|Version):[^\n]*\n){0,9}"
        r"""(?:[\x20\t\r\n\\"']*[A-Za-z0-9+/]{16,}={0,2})*(?:[\x20\t\r\n]*[A-Za-z0-9+/]{1,15}={1,2})?)""",
        0,
        1,
        "-----BEGIN [A-Z ]*PRIVATE KEY",
        version=2,
    ),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh[pousr]_[A-Za-z0-9]{36}"),
)
BASE = 3
_MARK, _OTHER = "\x01", "\x02"
_NONE = "array<struct<start:bigint,ord:int,end:bigint,kind:string,rule:string>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in code points: matches are set off by a mark that the
    text holds no more, and the lengths of the pieces add up to positions."""
    plain = F.translate(text, _MARK, _OTHER)
    parts = F.split(F.regexp_replace(plain, rule.pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def step(acc, piece):
        n = F.length(piece).cast("bigint")
        counts = F.length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least
        span = F.struct(
            acc["at"].alias("start"), F.lit(order).alias("ord"), (acc["at"] + n).alias("end"), F.lit(rule.kind).alias("kind"),
            F.lit(rule.key).alias("rule"),
        )
        return F.struct(
            (acc["at"] + n).alias("at"),
            (~acc["match"]).alias("match"),
            F.when(acc["match"] & counts, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("match"), F.array().cast(_NONE).alias("out")
    )
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    path_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: findings hold one row ``(path, blob, spans)`` per row of
    ``versions``, spans sorted by start and then rule; the ledger is
    ``(blob, rules, spans)`` for every blob known so far, stored.

    Null text is the empty blob. Paths may be null, repeated, or hold several
    versions. Spans of a rule version no longer in ``rules`` stay in the ledger
    and are left out of findings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    addressed = store(versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob")), "blobs")
    keys = [r.key for r in rules]
    every = F.array(*[F.lit(k) for k in keys])
    # one path stands for its blob
    reps = addressed.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("rep"))
    if ledger is None:
        fresh = reps.select("blob", F.col("rep.path").alias("rep"), every.alias("todo"))
    else:
        known = ledger.select(F.col("blob").alias("known"), F.col("rules").alias("done"))
        todo = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        fresh = (
            reps.join(known, F.col("blob") == F.col("known"), "left")
            .select("blob", F.col("rep.path").alias("rep"), todo.alias("todo"))
            .where(F.size("todo") > 0)
        )
    source = versions.select(F.col(path_col).alias("path"), text.alias("t")).withColumn("own", F.sha2("t", 256))
    chosen = source.join(fresh, F.col("path").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("blob")))
    found = F.concat(
        *[
            F.when(F.array_contains("todo", r.key) & F.col("t").rlike(r.hint), _spans(F.col("t"), r, i + 1)).otherwise(
                F.array().cast(_NONE)
            )
            for i, r in enumerate(rules)
        ]
    )
    scanned = store(chosen.select("blob", found.alias("spans")).where(F.size("spans") > 0), "spans").dropDuplicates(["blob"])
    new = fresh.join(scanned, "blob", "left").select(
        "blob", F.col("todo").alias("rules"), F.coalesce("spans", F.array().cast(_NONE)).alias("spans")
    )
    if ledger is not None:
        new = (
            ledger.select("blob", "rules", "spans")
            .union(new)
            .groupBy("blob")  # two rows at most
            .agg(F.flatten(F.collect_list("rules")).alias("rules"), F.flatten(F.collect_list("spans")).alias("spans"))
        )
    ledger = store(new, "ledger")
    # spans of other versions stay behind, and the order is that of these rules
    order = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i + 1))])
    current = F.filter("spans", lambda s: F.array_contains(every, s["rule"]))
    current = F.transform(current, lambda s: s.withField("ord", order[s["rule"]]))
    hits = ledger.where(F.size("spans") > 0).select(F.col("blob").alias("of"), F.array_sort(current).alias("spans"))
    findings = addressed.join(hits, F.col("blob") == F.col("of"), "left").select(
        F.col("path").alias(path_col), "blob", F.coalesce("spans", F.array().cast(_NONE)).alias("spans")
    )
    return findings, ledger


def joined(spans) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base(spans) -> Column:
    return F.filter(spans, lambda s: s["ord"] <= BASE)


def count_of(spans, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


_DUCK = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
m AS (
{parts}
),
p AS (SELECT row_no, ord, kind, least, grp, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM m),
q AS (SELECT *, sum(length(s)) OVER (PARTITION BY row_no, ord ORDER BY i) AS e FROM p),
f AS (SELECT row_no, ord, kind, e - length(s) AS a, e FROM q WHERE i % 2 = 0 AND (
{tests}
)),
g AS (SELECT row_no,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign,
  count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) FILTER (WHERE ord <= 3) AS base,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) AS spans
  FROM f GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_no)
"""


def oracle_sql() -> str:
    """The findings of ``RULES`` over ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = "\nUNION ALL\n".join(
        f"SELECT row_no, {i + 1} AS ord, {quote(r.kind)} AS kind, {r.least} AS least, {r.group} AS grp, "
        f"string_split(regexp_replace(t, {quote(r.pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d"
        for i, r in enumerate(RULES)
    )
    tests = "\nOR ".join(
        f"ord = {i + 1} AND length(regexp_extract(s, {quote(r.pattern)}, {r.group})) >= {r.least}" for i, r in enumerate(RULES)
    )
    return _DUCK.format(parts=parts, tests=tests)

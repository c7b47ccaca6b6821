"""Column -> Column helpers shared by every operator.

All helpers are built from native Spark SQL expressions, so they stay inside
whole-stage codegen and work the same in batch and streaming plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set on the BMP: ASCII \s plus the information
# separators, NEL and every Unicode space separator (incl. U+00A0).
PY_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
SPACES = ASCII_SPACES + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# A whole number as Python's ``\b\d+\b`` sees it on ASCII digits: no letter,
# digit or underscore on either side. A digit is asked for first, as looking
# behind every character costs far more.
WHOLE_NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw_key(seed: int | Column, *parts: Column | str | int) -> Column:
    """The md5 input ``seed:part1:part2...`` used by :func:`draw`."""
    items = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    for p in parts:
        if isinstance(p, Column):
            items.append(p.cast("string"))
        else:
            items.append(F.lit(str(p)))
    return F.concat_ws(":", *items)


def draw_u32(seed: int | Column, *parts: Column | str | int) -> Column:
    """Deterministic 32-bit unsigned value from md5 of ``seed:parts``.

    Reproducible, independent of partitioning and row order, and expressible
    in plain SQL on other engines (first 8 hex digits of the md5).
    """
    return F.conv(F.substring(F.md5(draw_key(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def draw(seed: int | Column, *parts: Column | str | int, n: Column | int) -> Column:
    """Uniform choice in ``[0, n)``; NULL when ``n`` is NULL or not positive."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.when(n_col > 0, F.pmod(draw_u32(seed, *parts), n_col.cast("bigint")))


def utrim(c: Column | str) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not only spaces). Only the ends are read."""
    return F.btrim(col_(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    """Python ``not s or not s.strip()``; NULL counts as blank. The search ends at
    the first character that is no white space."""
    c = col_(c)
    return c.isNull() | ~c.rlike(f"[^{PY_SPACE[1:]}")


def tokens(c: Column | str) -> Column:
    """Python ``str.split()``: runs of whitespace, no empty tokens. An ASCII text, by far the
    most common, is cut by a class of single characters, which the regex engine
    looks up; the classes of all of Unicode are asked one after the other."""
    c = col_(c)
    ascii_words, words = (F.regexp_extract_all(c, F.lit(f"[^{spaces}]+"), 0) for spaces in (ASCII_SPACES, PY_SPACE[1:-1]))
    return F.when(F.octet_length(c) == F.length(c), ascii_words).otherwise(words)


def replace_first(s: Column, find: Column | str, repl: Column | str) -> Column:
    """Python ``s.replace(find, repl, 1)`` for a non-empty ``find``."""
    find_c = F.lit(find) if isinstance(find, str) else find
    repl_c = F.lit(repl) if isinstance(repl, str) else repl
    pos = F.instr(s, find_c)
    return F.when(
        pos > 0,
        F.concat(F.substring(s, F.lit(1), pos - 1), repl_c, F.substring(s, pos + F.length(find_c), F.lit(1 << 30))),
    ).otherwise(s)


def splice_at(s: Column, pos: Column, cut_len: Column, repl: Column) -> Column:
    """``s[:pos-1] + repl + s[pos-1+cut_len:]`` with a 1-based ``pos``."""
    return F.concat(
        F.substring(s, F.lit(1), pos - 1),
        repl,
        F.substring(s, pos + cut_len, F.lit(1 << 30)),
    )


def keyword_hits(fix: Column, keywords: Column, low: Column | None = None) -> Column:
    """Number of keywords that are case-insensitive substrings of ``fix``; ``low`` is
    the lower-cased fix, if there is one, else it is formed for every keyword."""
    fix_l = low if low is not None else F.lower(F.coalesce(fix, F.lit("")))
    return F.size(F.filter(keywords, lambda k: F.contains(fix_l, F.lower(k))))


def safe_size(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0))


def round4(x: Column) -> Column:
    """Half-up rounding to 4 decimals: ``floor(x * 10000 + 0.5) / 10000``."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def element_at1(arr: Column, idx1: Column) -> Column:
    """``element_at`` that is NULL for a NULL index (Spark's own returns the
    last element there), so missing draws stay missing."""
    return F.when(idx1.isNotNull(), F.element_at(arr, idx1.cast("int")))


def element(arr_values: Sequence[str], idx0: Column) -> Column:
    """``values[idx0]`` for a 0-based index column over a literal list."""
    return element_at1(lit_array(arr_values), idx0 + 1)

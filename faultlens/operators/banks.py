"""Swap and term banks as tables.

A bank table has rows ``(bank, pos, find, repl)``: ``bank`` is an error type (swap
pairs) or ``logic_terms`` / ``dependency_terms`` (terms, ``repl`` unused), ``pos`` the
place in the bank. ``match`` finds for each text which entries occur, and picks
the one with the smallest drawn priority, as the literal expressions of
``inject`` do for the built-in banks, bit for bit. There are two ways:

* a bank table of at most ``AUTOMATON_BYTES`` (measured) becomes one Aho-Corasick
  automaton per bank, sent to the executors once; a text is read once whatever
  the number of entries, in Arrow batches;
* beyond that nothing is sent: the substrings of a text that are as long as some
  entry (cut at ``GRAM`` code points) and start as one does are joined to the entries by equality, and
  the few rows that meet are verified. Texts and entries are both shuffled, and
  no task holds a bank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import constants as K
from faultlens.functions.text import draw_key
from faultlens.plans.materialize import materialize

SCHEMA = "bank string, pos bigint, find string, repl string"
LOGIC, DEPENDENCY = "logic_terms", "dependency_terms"
#: Banks whose entries occur whatever the case of the text.
IGNORE_CASE = ("factual_error", LOGIC)
#: Where the keywords of an error type come from, if from a bank.
TERMS = {"factual_error": "factual_error", "logic_inversion": LOGIC, "cascade_dependency": DEPENDENCY}
AUTOMATON_BYTES = 64 << 20
GRAM = 32
#: Starts of entries, of START code points, by which a text's substrings are picked: PREFIXES at most, else all are cut.
START, PREFIXES = 5, 4096


def reference_banks(spark: SparkSession) -> DataFrame:
    """The built-in banks as a table."""
    from faultlens.operators.inject import SWAP_BANKS

    rows = [(bank, i, a, b) for bank, pairs in SWAP_BANKS.items() for i, (a, b) in enumerate(pairs)]
    rows += [(bank, i, t, None) for bank, terms in ((LOGIC, K.LOGIC_TERMS), (DEPENDENCY, K.DEPENDENCY_TERMS)) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, SCHEMA)


def with_reference(banks: DataFrame) -> DataFrame:
    """``banks`` and, for every bank it has no row of, the built-in one."""
    known = banks.select("bank").distinct()
    return banks.select("bank", "pos", "find", "repl").unionByName(reference_banks(banks.sparkSession).join(known, "bank", "left_anti"))


def _entries(banks: DataFrame) -> DataFrame:
    """``(bank, pos, key, find, repl)``: the key is lower-cased where case does not
    matter. Entries without a text to find never occur and are left out."""
    key = F.when(F.col("bank").isin(*IGNORE_CASE), F.lower("find")).otherwise(F.col("find"))
    return banks.where(F.length("find") > 0).select("bank", F.col("pos").cast("bigint").alias("pos"), key.alias("key"), "find", "repl")


def _checked(entries: DataFrame) -> int:
    """Bytes of the entries; places must be unique within a bank."""
    size = F.sum(F.octet_length("key") + F.octet_length("find") + F.coalesce(F.octet_length("repl"), F.lit(0)) + 32)
    per = entries.groupBy("bank", "pos").agg(F.count(F.lit(1)).alias("n"), size.alias("size"))
    twice, total = per.agg(F.max("n"), F.sum("size")).first()
    if (twice or 0) > 1:
        raise ValueError("two entries of a bank have the same place")
    return int(total or 0)


def match(df: DataFrame, banks: DataFrame, error_type: str, text: str, low: str, pid: str, seed: int,
          limit: int = AUTOMATON_BYTES) -> DataFrame:
    """``df`` with ``_hit STRUCT<find, repl>``, the drawn-first entry of the row's swap bank
    that occurs in ``text`` (NULL if none), and ``_terms``, the first entries that
    occur of the bank of its keywords, in bank order, ``MAX_KEYWORDS`` at most.
    ``low`` is the lower-cased text. A NULL text holds nothing."""
    entries = _entries(with_reference(banks))
    found = _by_automaton if _checked(entries) <= limit else _by_join
    return found(df, entries, error_type, text, low, pid, seed)


# ---------------------------------------------------------------------------
# Small banks: automata
# ---------------------------------------------------------------------------


class Automaton:
    """Places of the entries that occur in a text."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]]):
        self.pairs = {pos: (find, repl) for pos, _, find, repl in entries}
        by_key: dict[str, list[int]] = {}
        for pos, key, _, _ in entries:
            by_key.setdefault(key, []).append(pos)
        self.trie = ahocorasick.Automaton()
        for key, places in by_key.items():
            self.trie.add_word(key, places)
        if by_key:
            self.trie.make_automaton()
        self.empty = not by_key

    def places(self, text: str | None) -> set[int]:
        if self.empty or not text:
            return set()
        return {p for _, places in self.trie.iter(text) for p in places}


def priority(seed: int, pid: str | None, tag: str, places: set[int]) -> dict[int, int]:
    """The drawn priority of each place: six hex digits of a row of md5 values."""
    from faultlens.operators.inject import PRIO_HEX

    known: dict[int, str] = {}
    out = {}
    prefix = ":".join(str(x) for x in (seed, pid, tag) if x is not None)
    for p in places:
        first, at = divmod(PRIO_HEX * p, 32)
        digits = ""
        for j in (first, first + 1) if at + PRIO_HEX > 32 else (first,):  # most lie in one md5 value
            if j not in known:
                known[j] = hashlib.md5(f"{prefix}:{j}".encode()).hexdigest()  # noqa: S324
            digits += known[j]
        out[p] = int(digits[at : at + PRIO_HEX], 16)
    return out


def _by_automaton(df: DataFrame, entries: DataFrame, error_type: str, text: str, low: str, pid: str, seed: int) -> DataFrame:
    from faultlens.operators.inject import SWAP_TAGS

    by_bank: dict[str, list] = {}
    for r in entries.collect():  # AUTOMATON_BYTES at most
        by_bank.setdefault(r.bank, []).append((r.pos, r.key, r.find, r.repl))
    sent = df.sparkSession.sparkContext.broadcast(by_bank)

    @F.pandas_udf("find string, repl string, terms array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automata = {bank: Automaton(e) for bank, e in sent.value.items()}
        none = Automaton([])
        for kinds, texts, lows, pids in batches:
            finds, repls, terms = [], [], []
            for kind, own, lowered, key in zip(kinds, texts, lows, pids, strict=True):
                swap = automata.get(kind, none)
                places = swap.places(lowered if kind in IGNORE_CASE else own)
                if len(places) > 1:
                    drawn = priority(seed, key, SWAP_TAGS[kind], places)
                    best = min(places, key=lambda p: (drawn[p], p))
                else:  # nothing to draw
                    best = next(iter(places), None)
                find, repl = swap.pairs[best] if best is not None else (None, None)
                of = TERMS.get(kind)
                bank = automata.get(of, none)
                held = places if of == kind else bank.places(lowered if of in IGNORE_CASE else own)
                finds.append(find)
                repls.append(repl)
                terms.append([bank.pairs[p][0] for p in sorted(held)[: K.MAX_KEYWORDS]])
            yield pd.DataFrame({"find": finds, "repl": repls, "terms": terms}, columns=["find", "repl", "terms"])

    got = df.withColumn("_got", run(F.col(error_type), F.col(text), F.col(low), F.col(pid)))
    hit = F.when(F.col("_got.find").isNotNull(), F.struct(F.col("_got.find").alias("find"), F.col("_got.repl").alias("repl")))
    return got.withColumns({"_hit": hit, "_terms": F.col("_got.terms")}).drop("_got")


# ---------------------------------------------------------------------------
# Large banks: a join
# ---------------------------------------------------------------------------


def _drawn(seed: int, pid: Column, tag: Column, pos: Column) -> Column:
    """``priority`` as an expression, times INDEX plus the place."""
    from faultlens.operators.inject import INDEX, PRIO_HEX

    at = pos * PRIO_HEX
    j = F.floor(at / 32).cast("bigint")
    digits = F.concat(F.md5(draw_key(seed, pid, tag, j)), F.md5(draw_key(seed, pid, tag, j + 1)))
    return F.conv(F.substring(digits, (at % 32 + 1).cast("int"), F.lit(PRIO_HEX)), 16, 10).cast("bigint") * INDEX + pos


def _by_join(df: DataFrame, entries: DataFrame, error_type: str, text: str, low: str, pid: str, seed: int) -> DataFrame:
    from faultlens.operators.inject import SWAP_TAGS

    rows = materialize(df.drop(low).withColumn("_row", F.monotonically_increasing_id()), "matched").withColumn(low, F.lower(text))
    kind, ignored = F.col(error_type), lambda b: b.isin(*IGNORE_CASE)
    terms_of = F.create_map(*[F.lit(x) for kv in TERMS.items() for x in kv])[kind]
    banks = F.array_distinct(F.array_compact(F.array(kind, terms_of)))
    asked = rows.select("_row", F.explode(banks).alias("_bank"), F.col(text).alias("_own"), F.col(low).alias("_lowered"))
    asked = asked.select("_row", "_bank", F.when(ignored(F.col("_bank")), F.col("_lowered")).otherwise(F.col("_own")).alias("_hay"))
    entries = materialize(entries, "banks")
    gram = F.substring("key", 1, GRAM)
    lengths = sorted(r[0] for r in entries.select(F.length(gram)).distinct().collect())  # GRAM numbers at most
    starts: dict[int, list[str]] = {}
    found = entries.select(F.length(gram).alias("k"), F.substring("key", 1, START).alias("start")).distinct().limit(PREFIXES + 1).collect()
    for r in found if len(found) <= PREFIXES else ():
        starts.setdefault(r.k, []).append(r.start)
    hay, n = F.col("_hay"), F.length("_hay")

    def cut(k: int) -> Column:  # the substrings of k code points that start as an entry of that length
        at = F.sequence(F.lit(1), n - (k - 1))
        if starts:
            at = F.filter(at, lambda i: F.substring(hay, i, F.lit(min(k, START))).isin(starts[k]))
        return F.when(n >= k, F.transform(at, lambda i: F.substring(hay, i, F.lit(k))))

    cuts = [cut(k) for k in lengths]
    grams = asked.select("_row", "_bank", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*cuts))))).alias("_gram")) if cuts else None
    if grams is None:
        return rows.drop("_row").withColumns({"_hit": F.lit(None).cast("struct<find:string,repl:string>"), "_terms": F.array().cast("array<string>")})
    met = grams.join(entries, (F.col("_bank") == F.col("bank")) & (F.col("_gram") == gram))
    # an entry longer than GRAM is looked up in the whole text
    long_ = met.where(F.length("key") > GRAM).select("_row", "_bank", "pos", "key", "find", "repl").join(asked, ["_row", "_bank"])
    held = met.where(F.length("key") <= GRAM).select("_row", "bank", "pos", "find", "repl").unionByName(
        long_.where(F.instr(F.col("_hay"), F.col("key")) > 0).select("_row", F.col("_bank").alias("bank"), "pos", "find", "repl")
    )
    known = rows.select("_row", kind.alias("_kind"), terms_of.alias("_of"), F.col(pid).alias("_pid"))
    held = held.join(known, "_row")
    tag = F.create_map(*[F.lit(x) for kv in SWAP_TAGS.items() for x in kv])[F.col("bank")]
    drawn = F.struct(_drawn(seed, F.col("_pid"), tag, F.col("pos")).alias("prio"), "find", "repl")
    best = held.groupBy("_row").agg(
        F.min(F.when(F.col("bank") == F.col("_kind"), drawn)).alias("_best"),
        # places of one text's entries: as many as its substrings at most
        F.array_sort(F.collect_set(F.when(F.col("bank") == F.col("_of"), F.struct("pos", "find")))).alias("_held"),
    )
    joined = rows.join(best.withColumnRenamed("_row", "_at"), F.col("_row") == F.col("_at"), "left")
    hit = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best.find").alias("find"), F.col("_best.repl").alias("repl")))
    terms = F.coalesce(F.transform(F.slice("_held", 1, K.MAX_KEYWORDS), lambda x: x["find"]), F.array().cast("array<string>"))
    return joined.withColumns({"_hit": hit, "_terms": terms}).drop("_row", "_at", "_best", "_held")

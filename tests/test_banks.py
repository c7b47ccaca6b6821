"""Bank tables: both ways of matching equal the literal form on the built-in banks
and a brute-force version on large ones."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from faultlens.functions import constants as K
from faultlens.operators import banks as T
from faultlens.operators.inject import INDEX, SWAP_TAGS, build_episodes, inject_column
from faultlens.plans import bindings as B

TEXTS = ["x = int(y) and str(z)", "Uses DIVIDE-AND-CONQUER splitting, a < b, a >= c.", "sorted data in ascending order is correct, 12 items", "",
         None, "no hit at all", "return results[0] and data", "the model is statistically significant. Max score 7, min 3", "O(n log n) é 日本"]


def rows_of(spark, texts, kinds=tuple(SWAP_TAGS)):
    rows = [(e, t, f"p{i}" if i % 4 else None, i) for i, (e, t) in enumerate((e, t) for e in kinds for t in texts)]
    return spark.createDataFrame(rows, "e string, t string, p string, n int").repartition(3)


def result(df):
    return sorted((r.n, r.o, tuple(r.kw or ())) for r in df.collect())


@pytest.mark.parametrize("limit", [T.AUTOMATON_BYTES, 0])
def test_reference_banks_as_tables_equal_the_literal_form(spark, monkeypatch, limit):
    monkeypatch.setattr(T.match, "__defaults__", (limit,))
    df = rows_of(spark, TEXTS)
    literal = result(inject_column(df, "e", "t", "p", "o", keywords_out="kw"))
    for table in (T.reference_banks(spark), T.reference_banks(spark).limit(0)):
        assert result(inject_column(df, "e", "t", "p", "o", keywords_out="kw", swaps=table)) == literal
    assert len({o for _, o, _ in literal}) > 20


@pytest.mark.parametrize("limit", [T.AUTOMATON_BYTES, 0])
def test_episodes_of_given_traces(spark, monkeypatch, limit):
    monkeypatch.setattr(T.match, "__defaults__", (limit,))
    traces = B.lineitem_traces(spark, SF_SMALL).where(F.lit(limit > 0) | (F.col("trace_id") % 10 == 0))
    columns = ["pipeline_id", "corrupted_output", F.array_join("expected_fix_keywords", "|")]
    key = lambda bank: sorted(tuple(r) for r in bank.select(*columns).collect())
    assert key(build_episodes(traces, swaps=T.reference_banks(spark))) == key(build_episodes(traces))


def brute(pairs, kind, text, pid):
    hay = (text or "").lower() if kind in T.IGNORE_CASE else text or ""
    held = [i for i, (a, _) in enumerate(pairs) if a and (a.lower() if kind in T.IGNORE_CASE else a) in hay]
    drawn = T.priority(42, pid, SWAP_TAGS[kind], set(held))
    best = min(held, key=lambda i: drawn[i] * INDEX + i, default=None)
    return (None if best is None else pairs[best]), [pairs[i][0] for i in held[: K.MAX_KEYWORDS]]


@pytest.mark.parametrize("limit", [T.AUTOMATON_BYTES, 0])
def test_large_bank(spark, limit):
    """50,000 entries that contain each other, some longer than a gram."""
    rng = random.Random(1)
    pairs = [(f"part {i}", f"unit {i}") for i in range(49_990)]
    pairs += [("x" * 40 + str(i), f"long {i}") for i in range(8)] + [("", "never"), ("É", "e")]
    table = spark.createDataFrame([("factual_error", i, a, b) for i, (a, b) in enumerate(pairs)] + [("factual_error", 99_999, None, "n")], T.SCHEMA)
    texts = [" ".join(rng.choice(["Part", "of", str(rng.randrange(60_000)), "part"]) for _ in range(12)) for _ in range(60)]
    texts += ["PART 4999 and part 7", "x" * 50 + "3", "x" * 40 + "31", "é", None, "part 1" * 50]
    df = rows_of(spark, texts, ("factual_error",)).withColumn("l", F.lower("t"))
    got = T.match(df, table, "e", "t", "l", "p", 42, limit=limit).collect()
    assert len(got) == len(texts)
    for r in got:
        hit, terms = brute(pairs, "factual_error", r.t, r.p)
        assert (tuple(r._hit) if r._hit else None) == hit and list(r._terms) == terms, r.t
    assert sum(r._hit is not None for r in got) > 30


def test_places_must_be_unique(spark):
    table = spark.createDataFrame([("wrong_type", 1, "a", "b"), ("wrong_type", 1, "c", "d")], T.SCHEMA)
    with pytest.raises(ValueError, match="same place"):
        T.match(rows_of(spark, ["a"]).withColumn("l", F.lower("t")), table, "e", "t", "l", "p", 42)


def test_only_the_automaton_runs_python(spark):
    df = rows_of(spark, ["a"]).withColumn("l", F.lower("t"))
    plan = lambda limit: T.match(df, T.reference_banks(spark), "e", "t", "l", "p", 42, limit)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan(T.AUTOMATON_BYTES) and "Python" not in plan(0)


def test_substrings_are_cut_where_an_entry_starts(spark, monkeypatch):
    monkeypatch.setattr(T.match, "__defaults__", (0,))
    key = lambda df: sorted((r.pipeline_id, r.corrupted_output, tuple(r.expected_fix_keywords)) for r in df.collect())
    monkeypatch.setattr(B, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").where("l_orderkey < 300" if name == "lineitem" else "true"))
    df = rows_of(spark, ["part 12 of apart"], ("factual_error",)).withColumn("l", F.lower("t"))
    plan = lambda: T.match(df, B.part_swaps(spark, SF_SMALL), "e", "t", "l", "p", 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(sequence(" in plan()
    some = key(B.lineitem_bank_of_tables(spark, SF_SMALL))
    monkeypatch.setattr(T, "PREFIXES", 0)
    assert key(B.lineitem_bank_of_tables(spark, SF_SMALL)) == some and some
    monkeypatch.setattr(T.match, "__defaults__", (T.AUTOMATON_BYTES,))
    bank = B.lineitem_bank_of_tables(spark, SF_SMALL)
    assert key(bank) == some and not {"clean_pipeline", "corrupted_pipeline"} & set(bank.columns)


def test_only_the_md5_values_that_are_needed_are_formed(monkeypatch):
    import hashlib

    from faultlens.operators import banks

    whole = "".join(hashlib.md5(f"7:p_1:fact:{j}".encode()).hexdigest() for j in range(40))  # noqa: S324
    asked, md5 = [], hashlib.md5
    monkeypatch.setattr(banks.hashlib, "md5", lambda b: asked.append(b) or md5(b))
    places = set(range(0, 200, 16))  # at the first digits of a value
    assert banks.priority(7, "p_1", "fact", places) == {p: int(whole[6 * p : 6 * p + 6], 16) for p in places}
    assert len(asked) == len(places)
    assert banks.priority(7, "p_1", "fact", {5}) == {5: int(whole[30:36], 16)}

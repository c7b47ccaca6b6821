"""Spelling variants of a corpus: PartEnum signatures over letter multisets.

A word is the binary vector of its letter multiset: one dimension for each
letter and occurrence number (the second `a` is a dimension of its own). One
inserted, deleted or replaced code point changes at most two dimensions. The
dimensions are dealt into ``PARTS`` partitions, and each way to leave two of
them out is a signature: two words at Hamming distance two or less agree in at
least one. Words are equi-joined on their signatures, and the pairs verified:
first the Hamming distance on a 64-bit fold, then the edit distance.

Frequent letters make some signatures common, so the join key holds, beside
the signature, the half of the word that one edit leaves alone. Of two words
whose shorter one has ``m`` code points, the first or the last ``m // 2`` are
the same in both, so a word stands under its own length and under one less.
No pair is lost, and nothing is capped.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store

RUN = r"[a-zÀ-ÿ]"
PARTS = 4
DISTANCE = 2
_SIGNATURES = tuple(itertools.combinations(range(PARTS), PARTS - DISTANCE))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASK = (1 << 64) - 1


def vocabulary(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(word, n)`` of the words that occur ``least_count`` times or more.

    A run is a maximal stretch of letters of the whole text with A-Z in lower case;
    where ``every`` divides the crc32 of ``<id>:<run>``, the run loses the code point
    at that number modulo its length. Null texts hold no runs; a null id is written
    as nothing. ``every`` = 0 leaves all runs as they are."""
    low = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    # a deletion only shortens, so shorter runs need not be looked at
    runs = F.regexp_extract_all(low, F.lit(f"{RUN}{{{max(least_length, 1)},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
        found = found.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length)
    else:
        found = found.select(F.col("run").alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed)


class Letters:
    """Hash, partition and mask of the dimensions met so far."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], tuple[int, int, int]] = {}

    def __getitem__(self, dim: tuple[str, int]) -> tuple[int, int, int]:
        found = self.known.get(dim)
        if found is None:
            h = _hash(f"{dim[0]}{dim[1]}", 1)
            # a letter's first occurrences are dealt in turn, so that no partition holds all frequent ones
            found = self.known[dim] = (_hash(f"{dim[0]}{dim[1]}", 2), (ord(dim[0]) + dim[1]) % PARTS, 1 << (h & 63))
        return found


def signatures(word: str, dims: Letters) -> tuple[list[int], int]:
    """One hash a signature, and the 64-bit fold of the vector: the parities of the
    dimensions that share a bit, so vectors differ in at least as many dimensions."""
    sums, mask, seen = [0] * PARTS, 0, {}
    for c in word:
        seen[c] = k = seen.get(c, 0) + 1
        h, part, bit = dims[c, k]
        sums[part] += h
        mask ^= bit
    mixed = [(s * (2 * p + 3)) & _MASK for p, s in enumerate(sums)]
    return [(sum(mixed[p] for p in chosen) * 31 + i) & _MASK for i, chosen in enumerate(_SIGNATURES)], mask


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(words: DataFrame) -> DataFrame:
    """``(word, n, mask, own array<bigint>, less array<bigint>)``: the join keys of a
    word under its own length and under one less."""

    def keys(word: str, found: list[int], size: int) -> list[int]:
        half = size // 2
        sides = (_hash(word[:half], size * 2), _hash(word[len(word) - half :], size * 2 + 1))
        return [_signed((s ^ h) & _MASK) for s in found for h in sides]

    def run(batches):
        dims = Letters()
        for b in batches:
            own, less, masks = [], [], []
            for w in b.column(0).to_pylist():
                found, mask = signatures(w, dims)
                own.append(keys(w, found, len(w)))
                less.append(keys(w, found, len(w) - 1))
                masks.append(_signed(mask))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(masks, pa.int64()), pa.array(own, longs), pa.array(less, longs)],
                names=["word", "n", "mask", "own", "less"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, mask bigint, own array<bigint>, less array<bigint>")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``(u, u_n, v, v_n)`` of distinct ``words(word, n)`` that differ by exactly
    one inserted, deleted or replaced code point, each pair once."""
    rows = keyed(words)
    a = rows.select(F.explode("own").alias("k"), F.col("word").alias("u"), F.col("n").alias("u_n"), F.col("mask").alias("u_mask"))
    both = F.concat(
        F.transform("own", lambda k: F.struct(k.alias("k"), F.lit(False).alias("longer"))),
        F.transform("less", lambda k: F.struct(k.alias("k"), F.lit(True).alias("longer"))),
    )
    b = rows.select(F.explode(both).alias("s"), F.col("word").alias("v"), F.col("n").alias("v_n"), F.col("mask").alias("v_mask")).select(
        "s.k", "s.longer", "v", "v_n", "v_mask"
    )
    order = (F.col("longer") & (F.length("v") == F.length("u") + 1)) | (~F.col("longer") & (F.length("v") == F.length("u")) & (F.col("u") < F.col("v")))
    met = a.hint("merge").join(b, "k").where(order & (F.bit_count(F.col("u_mask").bitwiseXOR(F.col("v_mask"))) <= DISTANCE))
    return met.where(F.levenshtein("u", "v", 1) == 1).select("u", "u_n", "v", "v_n").distinct()


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(word, root)`` for every row of ``forms(word, form)``, by pointer doubling;
    a form's count is at least twice the word's, so there are no cycles."""
    cur = store(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        up = cur.select(F.col("word").alias("at"), F.col("root").alias("above"))
        nxt = store(cur.join(up, cur["root"] == up["at"], "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "root")
        cur = nxt.select("word", "root")
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest by code points) if
    that is at least ``factor`` times the word's own, else null; ``root`` follows
    forms to the last one. Words are taken as distinct; an empty table gives none."""
    if factor < 2:
        raise ValueError("forms of a factor under two could be cycles")
    words = store(words.select("word", "n"), "words")
    pairs = store(near_pairs(words), "pairs")
    ends = pairs.select(F.col("u").alias("near"), F.col("v").alias("other"), F.col("v_n").alias("m")).union(
        pairs.select(F.col("v").alias("near"), F.col("u").alias("other"), F.col("u_n").alias("m"))
    )
    best = ends.groupBy("near").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))).alias("best"))
    held = -F.col("best.less") >= factor * F.col("n")
    found = store(
        words.join(best, words["word"] == best["near"], "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(held, F.col("best.form")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return found.join(roots, found["word"] == roots["of"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def oracle_sql() -> str:
    """The contract's rows in DuckDB SQL: crc32 bit by bit, near words by the strings
    that one deletion leaves."""
    return f"""
        WITH RECURSIVE
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                        '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
        per AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS raw FROM runs WHERE length(run) >= 5 GROUP BY ALL),
        coded AS (SELECT *, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(length(raw) // 2),
                        lambda i: ('0x' || substr(raw, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                        lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS h FROM per),
        cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
                               ELSE run END AS word FROM coded),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        gaps AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
                 FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        near AS (SELECT DISTINCT * FROM (
                 SELECT a.word, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                 UNION ALL SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
                 UNION ALL SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word)),
        best AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(less := -m, form := near)) AS b FROM near GROUP BY word),
        found AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.form END AS form,
                         CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n FROM words LEFT JOIN best USING (word)),
        up AS (SELECT word, word AS root, 0 AS hops FROM found
               UNION ALL SELECT up.word, found.form, hops + 1 FROM up JOIN found ON up.root = found.word WHERE found.form IS NOT NULL)
        SELECT found.word, form, r.root, n, n_near, form_n
        FROM found JOIN (SELECT word, max_by(root, hops) AS root FROM up GROUP BY word) r USING (word)
    """

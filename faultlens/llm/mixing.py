"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target in words. Whole passes over the source fill as much of
it as they can; the rest is a budget of less than one pass, to be met by a
subset of the source's documents. Documents are counted by exact length, so a
source is a bounded knapsack over its distinct lengths: every length first
gives its share of the budget, the longest documents take what is left down to
a window of ``WINDOW`` words, and dynamic programming over reachable sums hits
the remaining budget, or the nearest sum there is. Which documents of a length
are taken is drawn by a seeded hash.

Only counts by length meet in a group, and positions within a length are
numbered by range pieces, so a source, or one length, may hold any share of
the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store
from faultlens.plans.dense import dense_index

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
WINDOW = 1 << 16
SEED = 42


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that the words taken are near
    ``budget``: 0 <= taken <= ``counts``. ``lengths`` are distinct and positive, in
    ascending order, and ``budget`` is at most their whole sum."""
    whole = int((lengths * counts).sum())
    if whole <= 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    taken = np.array([int(c) * budget // whole for c in counts.tolist()], np.int64)
    left = budget - sum(int(a) * int(b) for a, b in zip(lengths, taken, strict=True))
    for i in range(len(lengths) - 1, -1, -1):
        if left <= window:
            break
        size, free = int(lengths[i]), int(counts[i] - taken[i])
        more = min(free, -(-(left - window) // size), left // size)
        taken[i] += more
        left -= more * size
    return taken + _reach(lengths, counts - taken, left)


def _reach(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts whose sum is nearest to ``budget``, the smaller sum of two.

    Bit s of ``sums`` says that sum s is reachable; ``by[s]`` is the item, a power of
    two of documents of one length, that first reached it."""
    out = np.zeros(len(lengths), np.int64)
    top = 2 * budget  # a sum beyond is no nearer than none
    if budget <= 0:
        return out
    if budget > WINDOW:  # every document left is longer than the budget: one of them, or none
        near = [(abs(int(x) - budget), i) for i, x in enumerate(lengths) if free[i] and x < top]
        if near:
            out[min(near)[1]] = 1
        return out
    mask, sums, by, items = (1 << (top + 1)) - 1, 1, np.full(top + 1, -1, np.int32), []
    for i in range(len(lengths) - 1, -1, -1):
        size, n, step = int(lengths[i]), int(free[i]), 1
        n = min(n, top // size)
        while n > 0 and not sums >> budget & 1:
            take = min(step, n)
            grown = (sums | sums << size * take) & mask
            new = grown & ~sums
            if new:
                raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: top + 1])] = len(items)
                items.append((i, take))
            sums, n, step = grown, n - take, step * 2
        if sums >> budget & 1:
            break
    at = next(s for d in range(budget + 1) for s in (budget - d, budget + d) if sums >> s & 1)
    while at:
        i, take = items[by[at]]
        out[i] += take
        at -= take * int(lengths[i])
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``sizes(source, source_size)``.

    Sources in order of code points, null last, weigh ``weights`` in turn, and share all
    words by weight; a target stops at ``most`` times its source's size, and the
    excess is shared anew among the others until none is above. No words: all 0."""
    ranked = dense_index(sizes.withColumn("none", F.col("source").isNull()), [], ["none", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    cur = store(
        ranked.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "sources"
    )
    while True:  # each round fills a source at least
        words = F.sum(F.col("source_size").cast("decimal(38,0)"))
        held = F.sum(F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(0).cast("decimal(38,0)"))
        open_ = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0))
        total, gone, share = cur.agg(words, held, open_).first()
        left = int(total or 0) - int(gone or 0)
        if not share:
            break
        fair = F.lit(float(left)) * F.col("weight") / F.lit(float(share))
        over = ~F.col("full") & (fair > F.lit(most) * F.col("source_size"))
        if cur.where(over).isEmpty():
            break
        cur = store(cur.withColumn("full", F.col("full") | over), "sources")
    fair = F.lit(float(left)) * F.col("weight") / F.lit(float(share or 1))
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    return cur.select("source", "source_size", "weight", F.when(F.col("full"), cap).otherwise(fair).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, window: int = WINDOW,
) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)`` of every row, repeats
    included. ``size`` counts the words of the whole text (null: 0), ``copies`` says how
    often the mix takes the document (0 to ``most``), ``taken`` is copies * size.
    Documents without words are taken as often as their source is passed through.
    Null sources are one source. The draw is by a hash of seed, id and text; rows
    equal in all three may stand for each other, so reruns agree."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = store(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw")), "sizes")
    by_length = store(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = store(targets(sizes, weights, most), "targets")

    # a target is `passes` times the whole source and a budget under one more
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("bigint")
    budget = F.when(F.col("passes") < most, F.round(F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0.0).cast("bigint")
    plan = goal.withColumn("passes", passes).withColumn("budget", budget)

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("size")
        f["extra"] = fit_counts(f["size"].to_numpy(np.int64), f["n"].to_numpy(np.int64), int(f["budget"].iloc[0]), window)
        return f[["of", "size", "extra"]]

    kind = rows.schema["source"].dataType.simpleString()
    named = by_length.where("size > 0").withColumnRenamed("source", "of")
    known = named.join(plan.where("budget > 0"), F.col("of").eqNullSafe(F.col("source")))
    extra = known.select("of", "size", "n", "budget").groupBy("of").applyInPandas(choose, f"of {kind}, size bigint, extra bigint")
    extra = store(extra.where("extra > 0").withColumnRenamed("size", "of_size"), "chosen")

    # number the documents only of lengths that are taken in part
    joined = rows.join(extra, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    joined = joined.select("id", "source", "size", "draw", F.coalesce("extra", F.lit(0)).alias("extra"))
    first = dense_index(joined.where("extra > 0"), ["source", "size"], ["draw", "id"], "place")
    more = first.select("id", "source", "size", (F.col("place") <= F.col("extra")).cast("bigint").alias("more"))
    drawn = more.union(joined.where("extra = 0").select("id", "source", "size", F.lit(0).cast("bigint").alias("more")))
    ends = plan.select(F.col("source").alias("of"), "source_size", "target", "passes")
    copies = F.col("passes") + F.col("more")
    return drawn.join(ends, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )

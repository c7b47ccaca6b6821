"""Sequence packing by linear grouping and best fit.

1. Tokenize every document, append the end token, cut what is longer than a
   sequence into whole sequences after a shorter first piece.
2. Count the pieces by length: at most ``CAPACITY`` numbers reach the driver.
3. Plan on those counts. Large lengths, in descending order, form groups of
   equal cardinality, each rounded up to its largest member (linear grouping).
   For the few rounded sizes, configurations that fill a sequence are chosen
   and repeated as often as the counts allow. Actual lengths then take the
   slots, which frees what rounding had added, and small pieces go best-fit
   into the smallest space that holds them.
4. Join the plan's slot ranges back to the pieces by length and rank.

The plan is run-length coded: its rows grow with the number of distinct
lengths, never with the number of pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import store

CAPACITY = 1024
END_ID = 2
#: Groups of equal cardinality, so large pieces have that many sizes at most.
GROUPS = (16, 64, 256)
#: Lengths up to this share of a sequence are left to the best-fit step. A plan is made
#: for each number of groups and share, and the one with the fewest sequences is taken.
SMALL = (1 / 16, 1 / 8, 1 / 4, 1 / 2)


def pieces(docs: DataFrame, encoder, capacity: int = CAPACITY, end_id: int = END_ID, id_col="doc_id", text_col="text"):
    """One row per piece: id, piece, start, length, ids_crc32, and the piece's
    ``(part, rank)``: its rank among this task's pieces of the same length.

    ``encoder()`` is called in the task and returns ``text -> uint32 ids``. Null
    text is empty; an empty text is the end token alone."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
        + [T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]
    )

    def run(batches):
        encode, part = encoder(), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for b in batches:
            at, no, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    size = cuts[k + 1] - cuts[k]
                    at.append(i)
                    no.append(k)
                    start.append(cuts[k])
                    length.append(size)
                    crc.append(zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()))
                    rank.append(used[size])
                    used[size] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at, pa.int32())),
                    pa.array(no, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(at), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                names=schema.names,
            )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


class _Stock:
    """Pieces of one rounded size: runs ``[length, next rank, left]``, longest first."""

    def __init__(self):
        self.runs: list[list[int]] = []
        self.left = 0

    def add(self, length: int, rank: int, n: int):
        self.runs.append([length, rank, n])
        self.left += n


def _groups(counts: dict[int, int], n_groups: int) -> dict[int, _Stock]:
    """Linear grouping: equal-cardinality groups in descending length, each known
    by the size of its largest member."""
    total = sum(counts.values())
    card = max(1, -(-total // n_groups))
    out: dict[int, _Stock] = {}
    room, key = 0, 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            if not room:
                room, key = card, length
            take = min(n, room)
            out.setdefault(key, _Stock()).add(length, rank, take)
            rank, n, room = rank + take, n - take, room - take
    return out


def _configuration(sizes: np.ndarray, left: dict[int, int], first: int, capacity: int) -> list[int]:
    """Rounded sizes for one sequence that starts with ``first``: one, two or three
    more that fill it exactly, else the best fit, and so on."""
    config, used = [first], defaultdict(int, {first: 1})

    def has(s: int) -> bool:
        return left.get(s, 0) > used[s]

    room = capacity - first
    while room:
        if has(room):
            config.append(room)
            used[room] += 1
            break
        below = sizes[: np.searchsorted(sizes, room, side="right")]
        pair = None
        if len(below):
            rest = room - below
            both = below[(rest <= below) & np.isin(rest, below)][::-1]
            pair = next(((int(s), room - int(s)) for s in both if has(int(s)) and (left.get(room - int(s), 0) > used[room - int(s)] + (int(s) * 2 == room))), None)
        if pair:
            config += pair
            for s in pair:
                used[s] += 1
            break
        best = next((int(s) for s in below[::-1] if has(int(s))), None)
        if best is None:
            break
        config.append(best)
        used[best] += 1
        room -= best
    return config


def plan(counts: dict[int, int], capacity: int = CAPACITY, n_groups: int | tuple[int, ...] = GROUPS, small=SMALL) -> list[tuple]:
    """``(length, first rank, n, first sequence, offset)``: the pieces of this length
    ranked ``first rank + i``, ``i < n``, start at ``offset`` of sequence
    ``first sequence + i``. Covers every piece in ``counts`` once."""
    groups = (n_groups,) if isinstance(n_groups, int) else n_groups
    plans = [_plan(counts, capacity, n, share) for n in groups for share in small]
    return min(plans, key=lambda rows: max((first + n for _, _, n, first, _ in rows), default=0))


def _plan(counts: dict[int, int], capacity: int, n_groups: int, small: float) -> list[tuple]:
    rows: list[tuple] = []
    limit = int(capacity * small)
    stock = _groups({s: n for s, n in counts.items() if n and s > limit}, n_groups)
    sizes = np.array(sorted(stock))
    left = {s: x.left for s, x in stock.items()}
    spaces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # free -> (first sequence, n, offset)
    sequence = 0
    while len(sizes):
        config = _configuration(sizes, left, int(sizes[-1]), capacity)
        uses = {s: config.count(s) for s in config}
        times = min(left[s] // k for s, k in uses.items())
        for s, k in uses.items():
            left[s] -= times * k
        # actual pieces take the slots, in runs of equal lengths
        while times:
            n = times  # of this stretch: one run serves all slots of its size
            plan_slots: list[list[int]] = []
            for s in uses:
                runs, k = stock[s].runs, uses[s]
                if runs[0][2] >= k:
                    n = min(n, runs[0][2] // k)
                    plan_slots += [[s, 0]] * k
                else:  # the slots of one sequence span several runs
                    n = 1
                    taken, r = 0, 0
                    while taken < k:
                        t = min(runs[r][2], k - taken)
                        plan_slots += [[s, r]] * t
                        taken, r = taken + t, r + 1
            offset = 0
            for s, r in plan_slots:
                run = stock[s].runs[r]
                rows.append((run[0], run[1], n, sequence, offset))
                run[1] += n
                run[2] -= n
                offset += run[0]
            for s in uses:
                stock[s].runs = [x for x in stock[s].runs if x[2]]
            spaces[capacity - offset].append((sequence, n, offset))
            sequence += n
            times -= n
        sizes = np.array([s for s in sizes if left[int(s)]], dtype=sizes.dtype)
    # best fit of the small pieces, longest first
    for length in sorted((s for s, n in counts.items() if n and s <= limit), reverse=True):
        rank, n = 0, counts[length]
        while n:
            free = min((f for f in spaces if f >= length), default=None)
            if free is None:
                per = capacity // length
                new = -(-n // per)
                spaces[capacity].append((sequence, new, 0))
                sequence += new
                continue
            first, bins, offset = spaces[free].pop()
            if not spaces[free]:
                del spaces[free]
            t = min(n, bins)
            rows.append((length, rank, t, first, offset))
            rank, n = rank + t, n - t
            spaces[free - length].append((first, t, offset + length))
            if bins > t:
                spaces[free].append((first + t, bins - t, offset))
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``. An empty table
    stays empty."""
    spark = found.sparkSession
    cut = store(found, "pieces")
    tally = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = plan({k: v for k, v in counts.items() if k < capacity}, capacity)
    slots = spark.createDataFrame(rows, "length bigint, from_rank bigint, n bigint, first bigint, offset bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.where(F.col("length") < capacity).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    columns = [c for c in cut.columns if c not in ("part", "rank")]
    # a whole sequence needs no partner: numbered by task and rank, below zero
    whole = cut.where(F.col("length") == capacity).select(
        *columns,
        (-1 - F.shiftleft(F.col("part").cast("bigint"), 40) - F.col("rank")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    ranked = cut.where(F.col("length") < capacity).join(starts, ["length", "part"]).withColumn("r", F.col("base") + F.col("rank"))
    # the plan has a few rows per distinct length, whatever the input
    p = F.broadcast(slots.withColumnRenamed("length", "of"))
    fitted = ranked.join(p, (F.col("length") == F.col("of")) & (F.col("r") >= F.col("from_rank")) & (F.col("r") < F.col("from_rank") + F.col("n")))
    return fitted.select(*columns, (F.col("first") + F.col("r") - F.col("from_rank")).alias("sequence_id"), "offset").union(whole)


"""Hard negatives from a GNAT-style multiway hyperplane tree.

Inner products become distances: every row gets one more coordinate that lifts
all rows to the largest norm ``M``, and a query gets zero there, so that
``d^2 = |q|^2 + M^2 - 2 score``. A window of scores is an annulus about the query.

A node of the tree has up to ``FAN`` split points, and a row goes to the nearest
one (the hyperplanes between them part the space). For each split point the node
stores the range of distances to the rows of every sibling subtree, over all
rows. By the triangle inequality a subtree holds no row of the annulus if, for
one split point, its range and the annulus cannot meet. Leaves are exact: every
score in them is computed.

The split points come from a sample of ``SAMPLE`` rows (a documented bound of the
index, not of the result); rows are dealt to leaves, and leaves into pieces of
about ``PIECE`` rows, by Spark. Queries travel to the pieces of the leaves that
survive. Each search has two rounds: the query's home leaf first, whose k-th best
score narrows the window, then all leaves that the narrowed window leaves over.
Only k rows per window and piece leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import partitions, store

SCALE = 256
SAMPLE = 4096
FAN = 8
LEAF_SAMPLE = 64
PIECE = 4096
QUERIES = 1024
_CHUNK = 256
#: Sums of squares and products stay exact in doubles below this.
_EXACT = float(1 << 53)


def entries(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, label, v array<bigint>, n)``: floor(scale * x) of every component as double,
    equal rows counted. Rows with a null id, label or vector, an empty vector, or
    a null or non-finite component are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("n"))


def _matrix(rows, width: int = 0) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones padded with zeros."""
    rows = [np.asarray(r, np.float64) for r in rows]
    width = max(width, max((len(r) for r in rows), default=0))
    if all(len(r) == width for r in rows):
        return np.array(rows).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows of two matrices; the longer rows' tails
    meet nothing."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * w < _EXACT:
        return a @ b.T
    return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


class Tree:
    """The split points, and the distance ranges once ``learn`` has got them.

    ``nodes[i]`` is (points, lift of the points, children); a child is a node's
    number, or ``~leaf``."""

    def __init__(self, sample: np.ndarray, top: float, fan: int = FAN, least: int = LEAF_SAMPLE):
        self.top = top  # the largest squared norm
        self.fan, self.least, self.nodes, self.paths = fan, least, [], []
        self.ranges: dict[int, np.ndarray] = {}
        self._grow(sample, [])

    def _lift(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - _squares(rows), 0.0))

    def _distances(self, rows: np.ndarray, node: int, query: bool = False) -> np.ndarray:
        points, lift, _ = self.nodes[node]
        own = np.zeros(len(rows)) if query else self._lift(rows)
        w = min(points.shape[1], rows.shape[1])
        d2 = (_squares(rows) + own**2)[:, None] + self.top - 2 * (rows[:, :w] @ points[:, :w].T + own[:, None] * lift)
        return np.sqrt(np.maximum(d2, 0.0))

    def _grow(self, rows: np.ndarray, path: list[tuple[int, int]]) -> int:
        chosen = self._split_points(rows) if len(rows) > self.least else []
        if len(chosen) < 2:
            self.paths.append(path)
            return ~(len(self.paths) - 1)
        at = len(self.nodes)
        self.nodes.append((rows[chosen], self._lift(rows[chosen]), []))
        near = self._distances(rows, at).argmin(axis=1)
        children = [self._grow(rows[near == j], [*path, (at, j)]) for j in range(len(chosen))]
        self.nodes[at] = (*self.nodes[at][:2], children)
        return at

    def _split_points(self, rows: np.ndarray) -> list[int]:
        """Rows far from each other, the farthest from those chosen so far each time."""
        lift = self._lift(rows)
        chosen, gap = [0], np.full(len(rows), np.inf)
        while True:
            p = chosen[-1]
            gap = np.minimum(gap, ((rows - rows[p]) ** 2).sum(axis=1) + (lift - lift[p]) ** 2)
            if len(chosen) == self.fan or gap.max() < 1:
                return chosen
            chosen.append(int(gap.argmax()))

    def leaves(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """The leaf of each row: the nearest split point's at every node."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0 if self.nodes else ~0, np.arange(len(rows)))]
        while todo:
            at, who = todo.pop()
            if at < 0 or not len(who):
                out[who] = ~at
                continue
            near = self._distances(rows[who], at, query).argmin(axis=1)
            todo += [(child, who[near == j]) for j, child in enumerate(self.nodes[at][2])]
        return out

    def slots(self, leaf: int, rows: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """``(node, child, point, lo, hi)``: distances of a leaf's rows to the split
        points of the nodes above it."""
        out = []
        for node, child in self.paths[leaf]:
            d = self._distances(rows, node)
            out += [(node, child, i, float(a), float(z)) for i, (a, z) in enumerate(zip(d.min(axis=0), d.max(axis=0), strict=True))]
        return out

    def learn(self, slots) -> None:
        """Take ``(node, child, point, lo, hi)`` rows, the ranges over all rows."""
        for node, (points, _, _) in enumerate(self.nodes):
            self.ranges[node] = np.stack([np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)])
        for node, child, i, lo, hi in slots:
            self.ranges[node][:, child, i] = lo, hi

    def visit(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        """``(leaf, queries)`` that may meet: ``low`` and ``high`` (queries, windows) are
        score windows, an empty one has low over high."""
        both = (_squares(rows) + self.top)[:, None]
        inner, outer = np.sqrt(np.maximum(both - 2 * high, 0)), np.sqrt(np.maximum(both - 2 * low, 0))
        slack = 1e-6 * (1 + np.sqrt(both))  # rounding must not drop a row
        inner, outer = np.maximum(inner - slack, 0), np.where(low > high, -1.0, outer + slack)
        todo = [(0 if self.nodes else ~0, np.arange(len(rows)), np.ones(low.shape, bool) & (low <= high))]
        while todo:
            at, who, alive = todo.pop()
            some = alive.any(axis=1)
            who, alive = who[some], alive[some]
            if not len(who):
                continue
            if at < 0:
                yield ~at, who
                continue
            d = self._distances(rows[who], at, query=True)
            for j, child in enumerate(self.nodes[at][2]):
                lo, hi = self.ranges[at][:, j]
                if lo[0] > hi[0]:
                    continue  # no row came here
                least = np.maximum(np.maximum(d - hi, lo - d).max(axis=1), 0)[:, None]
                most = (d + hi).min(axis=1)[:, None]
                todo.append((child, who, alive & (least <= outer[who]) & (most >= inner[who])))


class Index:
    """A tree, the stored pieces of its leaves, and ``(leaf, pieces)``."""

    def __init__(self, tree: Tree, pieces: DataFrame, sizes: DataFrame):
        self.tree, self.pieces, self.sizes = tree, pieces, sizes


def build(rows: DataFrame, keep: int, sample: int = SAMPLE, piece: int = PIECE, fan: int = FAN, least: int = LEAF_SAMPLE) -> Index:
    """Index of ``entries``. Of equal vectors with one label only the ``keep`` smallest
    ids can be among the first ``keep - 1`` others of any query, so the index holds
    no more of them; all rows are represented."""
    same = Window.partitionBy("label", "v").orderBy("id")
    rows = rows.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= keep).drop("_nth")
    drawn = rows.select("v").orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()  # the bounded sample
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(square)).first()[0] or 0.0
    tree = Tree(_matrix([r.v for r in drawn]), float(top), fan, least)

    def deal(frames):
        for f in frames:
            yield f.assign(leaf=tree.leaves(_matrix(f["v"])))

    dealt = store(rows.mapInPandas(deal, "id bigint, label bigint, v array<bigint>, n bigint, leaf bigint"), "dealt")
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("bigint").alias("pieces"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        m = _matrix(f["v"])
        slots = tree.slots(int(f["leaf"].iloc[0]), m)
        return pd.DataFrame({
            "leaf": [f["leaf"].iloc[0]], "piece": [f["piece"].iloc[0]], "width": [m.shape[1]],
            "ids": [f["id"].to_numpy(np.int64).tobytes()], "labels": [f["label"].to_numpy(np.int64).tobytes()],
            "counts": [f["n"].to_numpy(np.int64).tobytes()], "data": [m.tobytes()],
            "slots": [[{"node": a, "child": b, "point": c, "lo": d, "hi": e} for a, b, c, d, e in slots]],
        })

    numbered = dealt.join(sizes.withColumnRenamed("leaf", "of"), F.col("leaf") == F.col("of"))
    numbered = numbered.select("id", "label", "v", "n", "leaf", F.pmod(F.xxhash64("id", "label"), "pieces").alias("piece"))
    slot = "array<struct<node:bigint,child:bigint,point:bigint,lo:double,hi:double>>"
    columns = f"leaf bigint, piece bigint, width bigint, ids binary, labels binary, counts binary, data binary, slots {slot}"
    pieces = store(numbered.groupBy("leaf", "piece").applyInPandas(pack, columns), "pieces")
    # one row a node, child and point: bounded by the sample
    ranges = pieces.select(F.inline("slots")).groupBy("node", "child", "point").agg(F.min("lo"), F.max("hi")).collect()
    tree.learn(tuple(r) for r in ranges)
    return Index(tree, pieces.drop("slots"), store(pieces.groupBy("leaf").agg((F.max("piece") + 1).alias("pieces")), "sizes"))


def _best(scores: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int):
    """``(row, column)`` of the first ``k`` of each row, by score and then id, repeats
    counted; -inf scores are no candidates. Columns ascend by id."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    times = np.minimum(counts[col], k)
    row, col = np.repeat(row, times), np.repeat(col, times)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def _search(index: Index, probes: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
    """``(aid, w, id, score)``: up to ``k`` rows a window from each piece met.
    ``probes(aid, id, label, v, low array<double>, high array<double>)``."""
    tree = index.tree

    def send(frames):
        for f in frames:
            for s in range(0, len(f), QUERIES):
                part = f.iloc[s : s + QUERIES]
                m = _matrix(part["v"])
                width = max(map(len, part["low"]))
                low, high = np.full((len(part), width), np.inf), np.full((len(part), width), -np.inf)
                for i, (a, z) in enumerate(zip(part["low"], part["high"], strict=True)):
                    low[i, : len(a)], high[i, : len(z)] = a, z
                if home:
                    leaf = tree.leaves(m, query=True)
                    met = [(x, np.flatnonzero(leaf == x)) for x in np.unique(leaf)]
                else:
                    met = tree.visit(m, low, high)
                out = [
                    {
                        "leaf": int(x), "q_width": m.shape[1], "windows": width, "aids": part["aid"].to_numpy(np.int64)[who].tobytes(),
                        "q_ids": part["id"].to_numpy(np.int64)[who].tobytes(), "q_labels": part["label"].to_numpy(np.int64)[who].tobytes(),
                        "low": low[who].tobytes(), "high": high[who].tobytes(), "q_data": m[who].tobytes(),
                    }
                    for x, who in met
                ]
                if out:
                    yield pd.DataFrame(out)

    def score(frames):
        long = lambda raw: np.frombuffer(raw, np.int64)
        for f in frames:
            for r in f.itertuples(index=False):
                data, ids, labels, counts = np.frombuffer(r.data).reshape(-1, r.width), long(r.ids), long(r.labels), long(r.counts)
                aids, q_ids, q_labels = long(r.aids), long(r.q_ids), long(r.q_labels)
                q_data, low, high = (np.frombuffer(x).reshape(len(aids), -1) for x in (r.q_data, r.low, r.high))
                out = []
                for s in range(0, len(aids), _CHUNK):
                    at = slice(s, s + _CHUNK)
                    scores = _products(q_data[at], data)
                    fits = ((labels == q_labels[at, None]) == same) & (ids != q_ids[at, None])
                    for w in range(r.windows):
                        inside = fits & (scores >= low[at, w, None]) & (scores <= high[at, w, None])
                        who = np.flatnonzero(inside.any(axis=1))
                        if not len(who):
                            continue
                        row, col = _best(np.where(inside[who], scores[who], -np.inf), ids, counts, k)
                        out.append((aids[at][who[row]], np.full(len(row), w), ids[col], scores[who[row], col].astype(np.int64)))
                if out:
                    a, w, i, x = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pd.DataFrame({"aid": a, "w": w, "id": i, "score": x})

    sent = probes.select("aid", "id", "label", "v", "low", "high").mapInPandas(
        send, "leaf bigint, q_width bigint, windows bigint, aids binary, q_ids binary, q_labels binary, low binary, high binary, q_data binary"
    )
    spread = sent.join(index.sizes, "leaf").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).drop("pieces")
    n = max(partitions(probes.sparkSession), 1)
    met = spread.repartition(n, "leaf", "piece").join(index.pieces.repartition(n, "leaf", "piece").hint("merge"), ["leaf", "piece"])
    found = met.mapInPandas(score, "aid bigint, w bigint, id bigint, score bigint")
    first = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)


def search(index: Index, probes: DataFrame, k: int, same: bool) -> DataFrame:
    """``(aid, w, nth, id, score)``: for each window ``w`` of a probe the first ``k`` rows
    (all, if fewer) with its label (``same``) or another, another id, and a score
    between ``low[w]`` and ``high[w]``; higher scores first, ties to smaller ids."""
    near = _search(index, probes, k, same, home=True).where(F.col("nth") == k)
    floors = near.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("score").cast("double")))).alias("floors"))
    narrowed = probes.join(floors, "aid", "left").withColumn(
        "low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(
            F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.col("floors")[w.cast("bigint")], x))))
    )
    return _search(index, narrowed, k, same, home=False)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, **sizes: int,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows where ``anchor`` (over the id, named ``id_col``) holds. A score
    is the inner product of quantized vectors, where a shorter vector goes on with
    zeros; higher scores come first, ties go to the smaller id. An anchor's
    positives are its first rows of the same label, and each positive's negatives
    the first rows of another label with low * p <= 100 * s <= high * p, for its score
    p. Rows under the anchor's id are none of its others. Equal rows are one anchor,
    and as positives or negatives count as often as they occur; ids that recur with
    another vector or label are rows of their own. Components are meant to stay
    below 2^31 once scaled. Empty tables, or anchors without positives or fitting
    negatives, give no rows."""
    rows = store(entries(vectors, id_col, vector_col, label_col, scale), "entries")
    index = build(rows, max(positives, negatives) + 1, **sizes)
    asked = rows.select(F.col("id").alias(id_col), "*").where(anchor).drop(id_col) if id_col != "id" else rows.where(anchor)
    asked = store(asked.select(F.monotonically_increasing_id().alias("aid"), "id", "label", "v"), "anchors")
    one = lambda x: F.array(F.lit(float(x)))
    found = store(search(index, asked.withColumns({"low": one("-inf"), "high": one("inf")}), positives, same=True), "positives")
    # five windows an anchor at most
    windows = found.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("p"))
    least = lambda p: F.ceil(p["score"] * low / F.lit(100.0)).cast("double")
    most = lambda p: F.floor(p["score"] * high / F.lit(100.0)).cast("double")
    probes = asked.join(windows, "aid").withColumns({"low": F.transform("p", least), "high": F.transform("p", most)})
    hits = search(index, store(probes.drop("p"), "probes"), negatives, same=False)
    named = hits.select("aid", (F.col("w") + 1).cast("int").alias("nth"), F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = found.select("aid", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        named.join(known, ["aid", "nth"])
        .join(asked.select("aid", F.col("id").alias("anchor_id")), "aid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )

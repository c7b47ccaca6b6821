"""Edit-aware token counting on segment trees of pre-tokens.

A document is cut into segments where a space stands between two other
non-space characters: a pre-token always starts there, so the document's token
count is the sum over its segments. Per document a binary tree holds the
characters and tokens below each node. An edit walks down to the segments it
touches; these are encoded again together with as much neighbouring text as
the boundaries depend on (one character on either side of the space), and the
sums above them are updated. Everything else keeps its count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 256
EDITS = "array<struct<at:bigint,cut:bigint,put:string>>"


def cuts(text: str, least: int = SEGMENT) -> list[int]:
    """Segment starts after the first: spaces with a non-space on both sides, at
    least ``least`` characters apart."""
    out, at, n = [], least, len(text)
    while True:
        at = text.find(" ", at)
        if at < 0 or at + 1 >= n:
            return out
        if at and not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(at)
            at += least
        else:
            at += 1


class Tree:
    """Complete binary tree over segment slots: ``chars`` and ``tokens`` as heaps,
    the root at 1, slot i at ``size + i``. Empty slots hold zeros."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def of(cls, lengths: list[int], counts: list[int]) -> Tree:
        size = 1
        while size < max(len(lengths), 1):
            size *= 2
        chars, tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        chars[size : size + len(lengths)], tokens[size : size + len(counts)] = lengths, counts
        for heap in (chars, tokens):
            level = size
            while level > 1:
                heap[level // 2 : level] = heap[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
        return cls(chars, tokens)

    def slot_at(self, at: int) -> tuple[int, int]:
        """The slot that holds character ``at`` (the last one in use for the end), and its start."""
        node, start = 1, 0
        at = max(0, min(at, int(self.chars[1]) - 1))
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, slot: int, n_chars: int, n_tokens: int):
        node = slot + self.size
        d_chars, d_tokens = n_chars - self.chars[node], n_tokens - self.tokens[node]
        while node:
            self.chars[node] += d_chars
            self.tokens[node] += d_tokens
            node //= 2


def build(text: str, count: Callable[[str], int]) -> Tree:
    """Tree of a whole text; the empty text has one empty segment."""
    edges = [0, *cuts(text), len(text)]
    parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Tree.of([len(p) for p in parts], [count(p) if p else 0 for p in parts])


def edit(text: str, tree: Tree, at: int, cut: int, put: str, count: Callable[[str], int]) -> tuple[str, Tree, int]:
    """Replaces ``cut`` characters at ``at`` by ``put`` (both clamped to the text) and
    updates the tree. Returns the new text, the tree, and how many characters were
    encoded again."""
    at = max(0, min(at, len(text)))
    cut = max(0, min(cut, len(text) - at))
    new = text[:at] + put + text[at + cut :]
    # a segment's start s is safe if the edit leaves s - 1, s and s + 1 alone
    first, start = tree.slot_at(at)
    if start and at < start + 2:
        first, start = tree.slot_at(start - 1)
    last, last_start = tree.slot_at(at + cut)
    end = last_start + int(tree.chars[tree.size + last])
    while end < len(text) and at + cut > end - 1:
        last, last_start = tree.slot_at(end)
        end = last_start + int(tree.chars[tree.size + last])
    part = new[start : end + len(put) - cut]
    edges = [0, *cuts(part), len(part)]
    pieces = [part[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    counts = [count(p) if p else 0 for p in pieces]
    slots = last - first + 1
    if len(pieces) > 4 * slots:  # too much for the touched slots: lay the tree out anew, from known counts
        used = slice(tree.size, 2 * tree.size)
        lengths, tokens = tree.chars[used].tolist(), tree.tokens[used].tolist()
        lengths[first : last + 1], tokens[first : last + 1] = [len(p) for p in pieces], counts
        keep = [i for i, n in enumerate(lengths) if n]
        return new, Tree.of([lengths[i] for i in keep], [tokens[i] for i in keep]), len(part)
    share = -(-len(pieces) // slots)
    for i in range(slots):
        own = slice(i * share, (i + 1) * share)
        tree.put(first + i, sum(map(len, pieces[own])), sum(counts[own]))
    return new, tree, len(part)


def trees(docs: DataFrame, counter: Callable[[], Callable[[str], int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, chars, tokens)`` of every row: the text, and its tree as two
    arrays whose element 1 is the total. Null text is empty. ``counter()`` is called
    in the task and returns ``text -> number of tokens``."""
    heap = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text", T.StringType())]
        + [T.StructField("chars", heap), T.StructField("tokens", heap)]
    )

    def run(batches):
        count = counter()
        for b in batches:
            built = [build(t.as_py() or "", count) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1).fill_null("")]
                + [pa.array([getattr(x, c) for x in built], pa.list_(pa.int64())) for c in ("chars", "tokens")],
                names=schema.names,
            )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def apply_edits(state: DataFrame, counter: Callable[[], Callable[[str], int]], id_col: str = "doc_id") -> DataFrame:
    """Rows of ``trees`` with an ``edits`` column (see ``EDITS``; null or empty: none),
    applied in turn, each on the text that the one before left. Adds ``encoded``,
    the characters encoded again. Null positions are 0, null texts empty."""
    heap = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField(id_col, state.schema[id_col].dataType), T.StructField("text", T.StringType())]
        + [T.StructField("chars", heap), T.StructField("tokens", heap), T.StructField("before", T.LongType()), T.StructField("encoded", T.LongType())]
    )

    def run(batches):
        count = counter()
        for b in batches:
            texts, found, before, encoded = [], [], [], []
            heaps = [b.column(c) for c in ("chars", "tokens")]
            for i, (text, edits) in enumerate(zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True)):
                tree = Tree(*(h[i].values.to_numpy(zero_copy_only=False).copy() for h in heaps))
                before.append(int(tree.tokens[1]))
                n = 0
                for e in edits or ():
                    text, tree, k = edit(text, tree, e["at"] or 0, e["cut"] or 0, e["put"] or "", count)
                    n += k
                texts.append(text)
                found.append(tree)
                encoded.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(texts, pa.string())]
                + [pa.array([getattr(x, c) for x in found], pa.list_(pa.int64())) for c in ("chars", "tokens")]
                + [pa.array(before, pa.int64()), pa.array(encoded, pa.int64())],
                names=schema.names,
            )

    return state.select(id_col, "text", "chars", "tokens", F.col("edits").cast(EDITS)).mapInArrow(run, schema)

"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into segments of a few megabytes inside
their tasks and stores, per segment, every term with the sorted list of its
token positions (term lists back to back, documents as position ranges). No
shuffle is needed and no list is longer than its segment, however common the
term.

Searches run over the stored segments. A phrase is found by taking its rarest
term's positions there, shifting them to the phrase start, and intersecting
with the shifted lists of the next rarest terms until none is left or all
agree. A proximity search asks for all terms within a span, in any order.

Words: A-Z in lower case, runs of digits, letters a-z and everything beyond
ASCII (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``). Null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import slices, store, utf8_buffers

WINDOW = 13
SEGMENT_BYTES = 4 << 20
#: Text of search phrases that one pass sends to every task; more goes in further passes.
PASS_BYTES = 16 << 20


def tokenize(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows as one binary array, and the first word's number of each
    row (with the total at the end)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    is_word = np.zeros(256, bool)
    is_word[48:58] = is_word[97:123] = is_word[128:] = True
    low = lower[data]
    mask = is_word[low]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    firsts = off[:-1][off[:-1] < off[-1]]
    start[firsts] = mask[firsts]
    begin = np.flatnonzero(start)
    # a word ends where the next one starts, less what is no word between
    inside = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    bounds = np.concatenate((inside[begin], inside[-1:]))
    kept = low[mask]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))]
    )
    return words, np.searchsorted(begin, off)


def _segment(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, list offsets and the positions of all terms' lists, back to back."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = (codes << 32) | np.arange(len(codes), dtype=np.int64)
    keys.sort()
    lists = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))))
    return coded.dictionary, lists.astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored segments; every row of ``docs`` is in one of them, under its position
    there, so repeated and null ids are kept apart. Any id type."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType())]
        + [T.StructField("ids", T.ArrayType(id_type))]
        + [T.StructField(c, T.BinaryType()) for c in ("docs", "terms", "term_off", "lists", "positions")]
    )

    def run(batches):
        part, seg = TaskContext.get().partitionId(), 0
        for b in batches:
            data, off = utf8_buffers(b.column(1))
            for lo, hi in slices(off, SEGMENT_BYTES):
                words, firsts = tokenize(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                terms, lists, positions = _segment(words)
                blob, term_off = utf8_buffers(terms)
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column(0).slice(lo, hi - lo))
                raw = (firsts.astype(np.int32), blob, term_off.astype(np.int32), lists, positions)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), ids]
                    + [pa.array([x.tobytes()], pa.binary()) for x in raw],
                    names=schema.names,
                )
                seg += 1

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
    return store(frame, "postings", {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1})


class Segment:
    """One stored segment, opened for search."""

    def __init__(self, docs: bytes, terms: bytes, term_off: bytes, lists: bytes, positions: bytes):
        self.docs = np.frombuffer(docs, np.int32)
        off = np.frombuffer(term_off, np.int32)
        self.terms = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(term_off), pa.py_buffer(terms)])
        self.lists = np.frombuffer(lists, np.int32)
        self.positions = np.frombuffer(positions, np.int32)

    def ids_of(self, words: pa.Array) -> np.ndarray:
        """Term number of each word, -1 where the segment lacks it."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        known = np.maximum(ids, 0)
        if not len(self.terms):
            return np.zeros(len(ids), np.int64)
        return np.where(ids >= 0, self.lists[known + 1] - self.lists[known], 0)

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term] : self.lists[term + 1]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.docs, at, side="right") - 1

    def phrase(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase within one document."""
        order = np.argsort(counts, kind="stable")
        at = self.list_of(ids[order[0]]) - np.int32(order[0])
        for k in order[1:]:
            if not len(at):
                return at
            found = self.list_of(ids[k])
            want = at + np.int32(k)
            slot = np.searchsorted(found, want)
            ok = slot < len(found)
            ok[ok] = found[slot[ok]] == want[ok]
            at = at[ok]
        if len(at):
            at = at[at >= 0]
            at = at[self.doc_of(at) == self.doc_of(at + np.int32(len(ids) - 1))]
        return at

    def near(self, ids: np.ndarray, counts: np.ndarray, span: int) -> np.ndarray:
        """Starts of stretches of at most ``span`` words that hold all terms, in any order."""
        ids, first = np.unique(ids, return_index=True)
        rare = self.list_of(ids[np.argmin(counts[first])])
        at = np.unique(np.concatenate([self.list_of(t) for t in ids]))
        slot = np.searchsorted(rare, at)  # only starts with a rarest term in reach
        ok = slot < len(rare)
        ok[ok] = rare[slot[ok]] - at[ok] < span
        at = at[ok]
        end = at.copy()
        for t in ids:
            found = self.list_of(t)
            slot = np.searchsorted(found, at)
            ok = slot < len(found)
            at, end, slot = at[ok], end[ok], slot[ok]
            end = np.maximum(end, found[slot])
        ok = (end - at < span) & (self.doc_of(at) == self.doc_of(end))
        return at[ok]


def _prepared(items: list[tuple], window: int):
    """Distinct words of all items, and per item its id and word numbers."""
    blob = [("" if t is None else t).encode() for _, t in items]
    off = np.concatenate(([0], np.cumsum([len(x) for x in blob]))).astype(np.int64)
    words, firsts = tokenize(np.frombuffer(b"".join(blob), np.uint8), off)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    vocabulary = coded.dictionary.to_pylist()
    return vocabulary, [(str(items[i][0]), codes[a:b]) for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)) if b > a]


def _passes(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items in parts whose text fits one pass each."""
    items = items.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // (PASS_BYTES // 2)) or 1
    if n == 1:
        return [items]
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(n))
    return [items.where(part == i) for i in range(n)]


def phrase_hits(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    id_col: str = "doc_id",
    span: int | None = None,
) -> DataFrame:
    """``(id, n_words, n_hit, items)`` for every indexed row.

    Windows of an item are its runs of ``window`` words, or the whole item where
    it is shorter. ``n_hit`` counts the row's words inside any occurrence of a
    window, ``items`` lists the ids (as sorted strings) of items with one. With
    ``span``, a window occurs where all its words lie within ``span`` words in
    any order, and that whole stretch is hit. Items with a null id are left out;
    items without words have no window; an empty item table hits nothing.
    """
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("seg", T.IntegerType()),
            T.StructField("no", T.IntegerType()),
            T.StructField(id_col, id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("runs", T.ArrayType(T.IntegerType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    parts = _passes(items, item_id, item_text)
    several = len(parts) > 1

    def one_pass(rows: list[tuple]) -> DataFrame:
        vocabulary, phrases = _prepared(rows, window)

        def run(batches):
            words = pa.array(vocabulary, pa.binary())
            for b in batches:
                for r in range(b.num_rows):
                    ids = b.column("ids").slice(r, 1).flatten()
                    s = Segment(*(b.column(c)[r].as_py() for c in ("docs", "terms", "term_off", "lists", "positions")))
                    known = s.ids_of(words)
                    counts = s.counts(known)
                    edge = np.zeros(int(s.docs[-1]) + 1, np.int32)
                    seen: list[tuple[int, np.ndarray]] = []
                    for k, (_, codes) in enumerate(phrases):
                        n = min(window, len(codes))
                        have = counts[codes]
                        views = np.lib.stride_tricks.sliding_window_view(have, n).min(axis=1)
                        for i in np.flatnonzero(views > 0):
                            term, freq = known[codes[i : i + n]], have[i : i + n]
                            at = s.phrase(term, freq) if span is None else s.near(term, freq, span)
                            if len(at):
                                np.add.at(edge, at, 1)
                                if span is None:
                                    np.add.at(edge, at + n, -1)
                                else:  # to the end of the stretch, or of the document
                                    np.add.at(edge, np.minimum(at + span, s.docs[s.doc_of(at) + 1]), -1)
                                seen.append((k, np.unique(s.doc_of(at))))
                    hit = np.cumsum(edge[:-1]) > 0
                    total = np.concatenate(([0], np.cumsum(hit)))
                    found: dict[int, set[str]] = {}
                    for k, docs in seen:
                        for d in docs.tolist():
                            found.setdefault(d, set()).add(phrases[k][0])
                    m = len(ids)
                    runs: list = [[]] * m
                    if found and several:
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                        cuts = np.union1d(turn, s.docs[:-1][hit[np.minimum(s.docs[:-1], len(hit) - 1)]])
                        for d in found:
                            a, z = s.docs[d], s.docs[d + 1]
                            own = np.unique(np.concatenate((cuts[(cuts >= a) & (cuts <= z)], [a, z])))
                            runs[d] = [int(x) for p, q in zip(own[:-1], own[1:], strict=True) if hit[p] for x in (p - a, q - a)]
                    b_part, b_seg = b.column("part")[r].as_py(), b.column("seg")[r].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b_part] * m, pa.int32()),
                            pa.array([b_seg] * m, pa.int32()),
                            pa.array(range(m), pa.int32()),
                            ids,
                            pa.array(np.diff(s.docs).astype(np.int64)),
                            pa.array((total[s.docs[1:]] - total[s.docs[:-1]]).astype(np.int64)),
                            pa.array(runs, pa.list_(pa.int32())),
                            pa.array([sorted(found.get(d, ())) for d in range(m)], pa.list_(pa.string())),
                        ],
                        names=schema.names,
                    )

        return index.mapInArrow(run, schema)

    frames = [one_pass([tuple(x) for x in part.collect()]) for part in parts]  # each bounded by PASS_BYTES
    if len(frames) == 1:
        return frames[0].select(id_col, "n_words", "n_hit", "items")
    every = frames[0]
    for f in frames[1:]:
        every = every.union(f)

    @F.udf("bigint")
    def covered(runs):
        spans = sorted((r[i], r[i + 1]) for r in runs for i in range(0, len(r), 2))
        n = last = 0
        for a, z in spans:
            n += max(0, z - max(a, last))
            last = max(last, z)
        return n

    return (
        every.groupBy("part", "seg", "no")
        .agg(  # a row for each pass
            F.first(id_col).alias(id_col),
            F.first("n_words").alias("n_words"),
            F.collect_list("runs").alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .select(id_col, "n_words", covered("runs").alias("n_hit"), "items")
    )


def contaminated(n_hit="n_hit", n_words="n_words"):
    """Contamination rule: a twentieth of the words or more lie in benchmark windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))

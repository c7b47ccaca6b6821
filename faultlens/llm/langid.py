"""Language identification by prediction by partial matching.

Every language has a context tree over bytes, of variable order up to
``ORDER``, learned from its training documents: per context the symbols that
followed and their counts. A byte's code length in a language is -log2 of its
probability in the longest context that has been seen, or that context's
escape and the code length under the next shorter context, down to a uniform
law over 256 bytes. Escapes follow method C: with n symbols of d kinds seen,
a symbol seen c times gets c / (n + d) and the escape d / (n + d).

After training the statistics are frozen, so the code length of a byte depends
only on itself and the ``ORDER`` bytes before it. The trees are laid out as
tables of finished code lengths: one row per seen context and symbol, one
escape row per seen context. A text's exact code length in every language is
then a sum of table rows, found by binary search over sorted context codes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import slices, utf8_buffers

ORDER = 3
#: Expected number of training documents per language; documents are drawn by a hash of their id and text.
SAMPLE = 800
MAX_LANGUAGES = 400
_LETTER = re.compile(r"[^\W\d_]")
_SLICE = 2 << 20


def sample(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = SAMPLE) -> DataFrame:
    """Training rows ``(lang, text)``: about ``per_language`` whole documents of each
    language (all, if it has fewer), the same ones on every run."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).cast("double") / 2.0**64) + 0.5
    return rows.where(draw <= share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def count_grams(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: counts of all byte strings of length ``ORDER`` + 1, as
    integers. Shorter histories at a text's start are padded with zero bytes."""

    def run(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            data, off = utf8_buffers(b.column(1))
            for lang in sorted(set(langs)):
                codes = [_codes(data[off[i] : off[i + 1]]) for i in np.flatnonzero(langs == lang)]
                grams, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _codes(data: np.ndarray) -> np.ndarray:
    """The last ``ORDER`` + 1 bytes up to each position, as one integer."""
    if not len(data):
        return np.zeros(0, np.uint32)
    code = data.astype(np.uint32)
    full = code.copy()
    for k in range(1, ORDER + 1):
        full[k:] |= code[:-k] << np.uint32(8 * k)
    return full


class Trees:
    """Frozen trees of all languages as sorted code tables.

    ``keys[o]`` holds the codes of order ``o`` (context of ``o`` bytes, then the
    symbol) seen in any language, ``cost[o]`` their code lengths there by language;
    ``contexts[o]`` and ``escape[o]`` the same for contexts alone. A language that
    lacks a context has escape 0 there: the context node does not exist in its tree.
    """

    def __init__(self, languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        counted = [self._levels(*grams[lang]) for lang in languages]
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for o in range(ORDER + 1) if languages else ():
            levels = [c[o] for c in counted]
            contexts = np.unique(np.concatenate([ctx for _, _, ctx, _, _ in levels]))
            escape = np.zeros((len(contexts), len(languages)), np.float32)
            for j, (_, _, ctx, total, kinds) in enumerate(levels):
                escape[np.searchsorted(contexts, ctx), j] = np.log2((total + kinds) / kinds)
            keys = np.unique(np.concatenate([k for k, _, _, _, _ in levels]))
            # without the symbol: the escape, then the shorter context's length
            cost = escape[np.searchsorted(contexts, keys >> np.uint32(8))] + self._shorter(keys, o)
            for j, (k, n, ctx, total, kinds) in enumerate(levels):
                at = np.searchsorted(ctx, k >> np.uint32(8))
                cost[np.searchsorted(keys, k), j] = np.log2((total[at] + kinds[at]) / n)
            self.contexts.append(contexts)
            self.escape.append(escape)
            self.keys.append(keys)
            self.cost.append(cost.astype(np.float32))
        self.tables = None

    @staticmethod
    def _levels(codes: np.ndarray, n: np.ndarray) -> list[tuple]:
        """Per order: codes, counts, contexts, and symbols and kinds of each context."""
        out = []
        for o in range(ORDER + 1):
            cut = codes.astype(np.uint64) & np.uint64((1 << (8 * (o + 1))) - 1)
            keys, at = np.unique(cut.astype(np.uint32), return_inverse=True)
            counts = np.bincount(at, weights=n, minlength=len(keys))
            contexts, at = np.unique(keys >> np.uint32(8), return_inverse=True)
            out.append((keys, counts, contexts, np.bincount(at, weights=counts), np.bincount(at).astype(float)))
        return out

    def _shorter(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of the codes under the context one byte shorter than ``order``."""
        if not order:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        return self._lookup(keys & np.uint32((1 << (8 * order)) - 1), order - 1)

    def _lookup(self, codes: np.ndarray, order: int) -> np.ndarray:
        out = np.empty((len(codes), len(self.languages)), np.float32)
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
        seen = keys[at] == codes if len(keys) else np.zeros(len(codes), bool)
        out[seen] = self.cost[order][at[seen]]
        if not seen.all():
            rest = codes[~seen]
            contexts, ctx = self.contexts[order], rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, ctx), max(len(contexts) - 1, 0))
            known = (contexts[at] == ctx)[:, None] if len(contexts) else np.zeros((len(rest), 1), bool)
            own = np.where(known, self.escape[order][at], 0) if len(contexts) else 0
            out[~seen] = own + self._shorter(rest, order)
        return out

    def open(self):
        """Hash slots over the highest order, so that a whole text needs no binary search."""
        if not self.languages:
            return self
        keys = self.keys[ORDER]
        bits = max(int(np.ceil(np.log2(max(len(keys), 1) * 4))), 8)
        slot = np.full(1 << bits, -1, np.int32)
        at = (keys * np.uint32(2654435761)) >> np.uint32(32 - bits)
        slot[at[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)  # the rest of a slot's keys are searched for
        self.tables = slot, bits
        return self

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of every row of a buffer in every language."""
        n = len(off) - 1
        if not len(data) or not self.languages:
            return np.zeros((n, len(self.languages)))
        codes = _codes(data)
        for k in range(1, ORDER + 1):  # histories end at the row's start
            first = off[:-1] + k - 1
            first = first[first < off[1:]]
            codes[first] &= np.uint32((1 << (8 * k)) - 1)
        slot, bits = self.tables
        at = slot[(codes * np.uint32(2654435761)) >> np.uint32(32 - bits)]
        keys, cost = self.keys[ORDER], self.cost[ORDER]
        hit = (at >= 0) & (keys[at] == codes) if len(keys) else np.zeros(len(codes), bool)
        miss = np.flatnonzero(~hit)
        rows = np.maximum(at, 0)
        extra, where = np.unique(codes[miss], return_inverse=True)
        full = np.concatenate((cost, self._lookup(extra, ORDER))) if len(miss) else cost
        rows[miss] = len(cost) + where
        out = np.empty((n, len(self.languages)))
        busy = off[:-1] < off[1:]
        for j in range(len(self.languages)):
            bits_of = np.ascontiguousarray(full[:, j])[rows]
            out[busy, j] = np.add.reduceat(bits_of, off[:-1][busy], dtype=np.float64)
        out[~busy] = 0
        return out


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = SAMPLE) -> Trees:
    """Trees of the languages in ``docs``. What comes to the driver is bounded by
    the sample: at most the distinct grams of its documents."""
    rows = count_grams(sample(docs, id_col, text_col, lang_col, per_language)).toArrow()
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    gram, n = rows.column("gram").to_numpy().astype(np.uint32), rows.column("n").to_numpy()
    languages = sorted(set(langs))
    return Trees(languages, {x: (gram[langs == x], n[langs == x]) for x in languages})


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row: the language of the shortest code
    (ties: first by name) and its share 2^-bits among all; ``und`` with score 0 for
    null text, text without a letter, or trees without a language."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        model = trees.open()  # travels with the task; bounded by the training sample
        for b in batches:
            data, off = utf8_buffers(b.column(1))
            lengths = [model.code_lengths(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off, _SLICE)]
            bits = np.concatenate(lengths) if lengths else np.zeros((0, len(model.languages)))
            if not model.languages:
                names, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            else:
                best = bits.argmin(axis=1)
                gap = bits - bits[np.arange(len(bits)), best][:, None]
                scores = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                names = [model.languages[k] for k in best]
            for i, t in enumerate(b.column(1)):
                if not _LETTER.search(t.as_py() or ""):
                    names[i], scores[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text is 2 modulo 4; null ids are held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))

"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

Features come from the whole text: densities of two lexicons, hits near
second-person words, capitals, punctuation and obfuscation rates, and lengths.
One lexicon is a fixed list of insults, in plain and obfuscated spellings. The
other is learned: words, and beginnings of words, that mark labelled toxic
documents, whatever the language. Spark ML fits boosted trees on labelled rows
that the lexicon was not learned from, and an isotonic curve on rows that
neither has seen, which turns raw scores into probabilities.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import slices, store, utf8_buffers
from faultlens.llm.decontaminate import tokenize

# Common insults and slurs of general use, by language.
LEXICON = frozenset(
    """
    idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown
    clowns fool fools jerk jerks imbecile imbeciles cretin retard retarded bastard bastards asshole assholes bitch
    bitches bullshit shit shitty crap fuck fucking fucked fucker dickhead prick cunt whore slut twat wanker
    freak freaks filth filthy vermin scumbag scumbags degenerate degenerates parasite parasites pigs swine
    coward cowards liar liars creep creeps maggot maggots brainless braindead useless ugly nasty vile repulsive
    hate hateful idiotic moronic screwed suck sucks lunatic psycho dimwit halfwit nitwit dunce
    dummkopf arschloch scheisse scheiße trottel vollidiot schwachkopf abschaum dreck wichser hurensohn schlampe
    connard connasse salope putain merde imbécile crétin abruti débile ordure salaud enculé
    idiota imbécil estúpido estúpida pendejo cabrón mierda puta basura gilipollas inútil tonto asqueroso
    """.split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton vous votre tú ti usted ustedes".split())
NEAR = 6
#: Labelled documents of either label that the lexicon is learned from at most, drawn by hash.
LEXICON_DOCS = 4000
#: Entries of the learned lexicon at most, and the labelled documents that an entry occurs in at least.
ENTRIES, SEEN = 4096, 8
#: Bytes of the word beginnings that are entries beside whole words.
STARTS = range(3, 11)
#: Weights (a lower bound of the log odds) from which a word counts as a mild or strong sign.
MILD, STRONG = 1.0, 2.5
FEATURES = (
    "words", "mean_word", "hits", "hit_rate", "distinct_hits", "hits_in_100", "masked", "masked_rate", "near_you", "near_share",
    "you_rate", "capitals", "shouted_rate", "exclaims", "questions", "punctuation", "symbols", "digits", "obfuscated_rate", "stretched_rate",
    "learned_max", "learned_hits", "learned_rate", "learned_distinct", "learned_near", "mild_rate", "learned_mean",
)

# words joined by marks, and letters set apart
_MARKED = re.compile(r"[^\W_]*+(?:[@$*.\-_!+]{1,2}[^\W_]++)+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
_SLICE = 1 << 20


def _class_of_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a : z + 1] = True
    return out


UPPER, LETTER, DIGIT = _class_of_bytes((65, 90)), _class_of_bytes((65, 90), (97, 122), (128, 255)), _class_of_bytes((48, 57))
PUNCT = _class_of_bytes((33, 47), (58, 64), (91, 96), (123, 126))
SYMBOL = _class_of_bytes((35, 38), (42, 43), (64, 64), (94, 96))
MARK = _class_of_bytes(*[(ord(c), ord(c)) for c in "@$*.-_!+"])


def _is_insult(word: str) -> bool:
    """Whether a word is of the lexicon once digits and marks are read as letters,
    marks are dropped, or drawn-out letters are shortened."""
    plain = re.sub(r"\W|_", "", word.translate(_LEET))
    return any(w in LEXICON for w in (plain, _STRETCH.sub(r"\1", plain), _STRETCH.sub(r"\1\1", plain)))


def _masked(text: str) -> int:
    """Insults whose letters are set apart or joined by marks."""
    low = text.lower()
    return sum(map(_is_insult, _MARKED.findall(low))) + sum(_is_insult(m.replace(" ", "")) for m in _SPACED.findall(low))


class Lexicon:
    """Weights of whole words and of word beginnings, as bytes with A-Z in lower case.
    ``entries`` are (length, term, weight); length 0 is a whole word."""

    def __init__(self, entries=()):
        by_length: dict[int, list[tuple[bytes, float]]] = {}
        for k, term, weight in entries:
            by_length.setdefault(int(k), []).append((bytes(term), float(weight)))
        self.parts = {k: ([t for t, _ in e], np.array([w for _, w in e])) for k, e in by_length.items()}

    def weights(self, words: pa.Array) -> np.ndarray:
        """The largest weight of an entry that each word is or begins with; 0 without."""
        out = np.zeros(len(words))
        for k, (terms, weights) in self.parts.items():
            at = pc.index_in(_starts(words, k), value_set=pa.array(terms, pa.large_binary()))
            at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
            out = np.maximum(out, np.where(at >= 0, weights[at], 0.0))
        return out


def _starts(words: pa.Array, k: int) -> pa.Array:
    """The first ``k`` bytes of words that are longer, null for others; all of every
    word for 0."""
    if not k:
        return words
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    cut = pc.binary_slice(words.cast(pa.large_binary()), 0, k)
    return pc.if_else(pa.array(np.diff(edges) > k), cut, pa.scalar(None, cut.type))


def feature_rows(data: np.ndarray, off: np.ndarray, lexicon: Lexicon | None = None) -> np.ndarray:
    """The values of ``FEATURES`` for the texts of a UTF-8 buffer, whole texts; all
    zero for an empty one. Everything but rare spellings is counted on arrays."""
    n, size = len(off) - 1, np.diff(off).astype(float)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    per_byte = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    words, firsts = tokenize(data, off)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    listed = lambda terms: pc.is_in(coded.dictionary, value_set=pa.array([t.encode() for t in sorted(terms)], pa.large_binary()))
    flags = [listed(t).to_numpy(zero_copy_only=False)[codes] for t in (LEXICON, SECOND_PERSON)]
    hit, you = (np.flatnonzero(f) for f in flags)
    count = np.diff(firsts).astype(float)
    doc = np.searchsorted(firsts, hit, side="right") - 1
    in_doc = lambda at: np.bincount(at, minlength=n).astype(float)

    def close_to_you(hit, doc):  # within NEAR words of a second-person word of the same text
        after = np.searchsorted(you, hit)
        near = np.zeros(len(hit), bool)
        for k in (after - 1, after):
            ok = (k >= 0) & (k < len(you))
            at = you[np.clip(k, 0, max(len(you) - 1, 0))] if len(you) else hit
            near |= ok & (np.abs(at - hit) <= NEAR) & (at >= firsts[doc]) & (at < firsts[doc + 1])
        return near

    near = close_to_you(hit, doc)
    weight = (lexicon or Lexicon()).weights(coded.dictionary)[codes]
    sign = np.flatnonzero(weight >= STRONG)
    sign_doc = np.searchsorted(firsts, sign, side="right") - 1
    word_doc = np.repeat(np.arange(n), np.diff(firsts))
    strongest = np.zeros(n)
    np.maximum.at(strongest, word_doc, weight)
    signs = np.unique(sign_doc * (len(coded.dictionary) + 1) + codes[sign]) // (len(coded.dictionary) + 1)
    dense = np.zeros(n)
    np.maximum.at(dense, doc, np.searchsorted(hit, np.minimum(hit + 100, firsts[doc + 1])) - np.arange(len(hit)))
    pairs = np.unique(doc * (len(coded.dictionary) + 1) + codes[hit]) // (len(coded.dictionary) + 1)
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    length = np.diff(edges)
    upper, letter = UPPER[data], LETTER[data]
    is_word = letter | DIGIT[data]
    capital = np.add.reduceat(upper[is_word], edges[:-1], dtype=np.int64) if len(words) else np.zeros(0, int)
    shouted = np.flatnonzero((length >= 3) & (capital == length))
    low = np.where(upper, data | 32, data)
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:]
        triple[3:] &= low[3:] != low[:-3]  # once a run
    begin, end = off[:-1][size > 0], off[1:][size > 0]
    triple[begin] = triple[np.minimum(begin + 1, len(data) - 1)] = False  # letters of the text before
    stretched = per_byte(triple)
    # odd spellings within a word are looked up once for each distinct word
    digits = np.add.reduceat(DIGIT[data][is_word], edges[:-1], dtype=np.int64) if len(words) else np.zeros(0, int)
    drawn = np.add.reduceat(triple[is_word], edges[:-1], dtype=np.int64) if len(words) else np.zeros(0, int)
    mixed = (digits > 0) & (digits < length)
    asked = np.unique(codes[(mixed | (drawn > 0)) & ~flags[0]])
    found = np.zeros(len(coded.dictionary), bool)
    found[asked] = [_is_insult(w.decode("utf-8", "replace")) for w in coded.dictionary.take(pa.array(asked)).to_pylist()]
    masked = in_doc(np.searchsorted(firsts, np.flatnonzero(found[codes]), side="right") - 1)
    # those across words need the text, where marks stand between word characters or single letters follow each other
    marks = MARK[data]
    inner = np.zeros(len(data), bool)
    inner[1:-1] = marks[1:-1] & is_word[:-2] & is_word[2:]
    inner[1:-2] |= marks[1:-2] & marks[2:-1] & is_word[:-3] & is_word[3:]
    inner[begin] = inner[end - 1] = inner[np.maximum(end - 2, 0)] = False  # no marks between two texts
    single = np.concatenate((length == 1, [False]))
    spaced = np.flatnonzero(single[:-4] & single[1:-3] & single[2:-2] & single[3:-1]) if len(single) > 4 else np.zeros(0, int)
    joined = per_byte(inner)
    for i in np.flatnonzero((joined > 0) | (in_doc(np.searchsorted(firsts, spaced, side="right") - 1) > 0)):
        masked[i] += _masked(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    obscured = joined + in_doc(np.searchsorted(firsts, np.flatnonzero(mixed), side="right") - 1)
    share = lambda x, of: x / np.maximum(of, 1)
    hits, close = in_doc(doc), in_doc(doc[near])
    chars = np.maximum(per_byte((data & 0xC0) != 0x80), 1)
    columns = (
        count, share(per_byte(is_word), count), hits, share(hits, count), in_doc(pairs), dense,
        masked, share(masked, count), close, share(close, hits), share(in_doc(np.searchsorted(firsts, you, side="right") - 1), count),
        share(per_byte(upper), per_byte(letter)), share(in_doc(np.searchsorted(firsts, shouted, side="right") - 1), count),
        per_byte(data == 33) / chars, per_byte(data == 63) / chars, per_byte(PUNCT[data]) / chars, per_byte(SYMBOL[data]) / chars,
        per_byte(DIGIT[data]) / chars, share(obscured, count), share(stretched, count),
        strongest, in_doc(sign_doc), share(in_doc(sign_doc), count), in_doc(signs), in_doc(sign_doc[close_to_you(sign, sign_doc)]),
        share(in_doc(word_doc[weight >= MILD]), count), share(np.bincount(word_doc, weights=weight, minlength=n), count),
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    out[size == 0] = 0
    return out


def features(text: str | None, lexicon: Lexicon | None = None) -> list[float]:
    """``feature_rows`` of one text; null counts as empty."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return feature_rows(raw, np.array([0, len(raw)]), lexicon).tolist()[0]


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Learn from ``(id, text, label)`` rows with label 0 or 1.

    Of either label the ``LEXICON_DOCS`` rows of smallest id hash are used. A term's
    weight is the log ratio of its smoothed document shares, toxic over clean,
    less its standard error; the ``ENTRIES`` largest from ``MILD`` on are kept, of
    terms in at least ``SEEN`` documents."""
    draw = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    drawn = store(labelled.withColumn("nth", F.row_number().over(draw)).where(F.col("nth") <= LEXICON_DOCS).select("text", "label"), "lexicon")

    def run(batches):
        for b in batches:
            data, off = utf8_buffers(b.column(0))
            label = b.column(1).to_numpy()
            for lo, hi in slices(off, _SLICE):
                words, firsts = tokenize(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                coded = words.dictionary_encode()
                width = max(len(coded.dictionary), 1)
                doc = np.repeat(np.arange(hi - lo), np.diff(firsts))
                once = np.unique(doc * width + coded.indices.to_numpy(zero_copy_only=False))
                doc, code = once // width, once % width
                for k in (0, *STARTS):
                    terms = _starts(coded.dictionary, k).dictionary_encode()
                    of = pc.fill_null(terms.indices, -1).to_numpy(zero_copy_only=False)[code]
                    size = max(len(terms.dictionary), 1)
                    pairs = np.unique(doc[of >= 0] * size + of[of >= 0])
                    toxic = label[lo:hi][pairs // size] == 1
                    n = [np.bincount((pairs % size)[side], minlength=len(terms.dictionary)) for side in (~toxic, toxic)]
                    columns = [pa.array(np.full(len(terms.dictionary), k, np.int32)), terms.dictionary.cast(pa.binary()), *map(pa.array, n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "term", "clean", "toxic"])

    counts = drawn.mapInArrow(run, "k int, term binary, clean bigint, toxic bigint")
    n = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        return Lexicon()
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(a / (n[1] + 1)) - F.log(b / (n[0] + 1)) - F.sqrt(1 / a + 1 / b)
    terms = counts.groupBy("k", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = terms.where(F.col("clean") + F.col("toxic") >= SEEN).select("k", "term", weight.alias("weight")).where(F.col("weight") >= MILD)
    return Lexicon(tuple(r) for r in kept.orderBy(F.desc("weight"), "k", "term").limit(ENTRIES).collect())


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """``(id, f array<double>)`` of every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            data, off = utf8_buffers(b.column(1))
            for lo, hi in slices(off, _SLICE):
                rows = feature_rows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lexicon)
                values = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), values], names=[id_col, "f"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _assembled(frame: DataFrame) -> DataFrame:
    wide = frame.select("*", *[F.col("f")[i].alias(f"x_{c}") for i, c in enumerate(FEATURES)])
    return VectorAssembler(inputCols=[f"x_{c}" for c in FEATURES], outputCol="x_all").transform(wide)


class Model:
    """Boosted trees, and the isotonic curve over their probability."""

    def __init__(self, trees, curve, share: float):
        self.trees, self.curve, self.share = trees, curve, share

    def score(self, frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``(id, score)`` of rows of ``featurize``; the raw probability breaks the
        curve's ties, with a weight of a thousandth."""
        if self.trees is None:
            return frame.select(id_col, F.lit(self.share).alias("score"))
        raw = self.trees.transform(_assembled(frame)).select(id_col, vector_to_array("probability")[1].alias("raw"))
        flat = self.curve.transform(raw)
        return flat.select(id_col, (0.999 * F.col("prediction") + 0.001 * F.col("raw")).alias("score"))


BINS = 1000
#: Rows in a leaf at least; a twentieth of the training rows, if that is fewer.
LEAF = 10


def fit(trees_on: DataFrame, curve_on: DataFrame, rounds: int = 20, depth: int = 2) -> Model:
    """Fit on ``(f, label)`` rows with label 0 or 1. Without both labels among the
    rows for the trees there is nothing to learn, and every score is the share of
    label 1 (0 without rows). The curve sees at most ``BINS`` + 1 weighted points,
    sums over all its rows."""
    n = {r["label"]: r["n"] for r in trees_on.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = n.get(1, 0) / max(sum(n.values()), 1)
    if len(n) < 2:
        return Model(None, None, float(share))
    least = max(1, min(LEAF, sum(n.values()) // 20))
    gbt = GBTClassifier(featuresCol="x_all", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=least, seed=7)
    trees = gbt.fit(_assembled(trees_on).select("x_all", F.col("label").cast("double").alias("label")))
    raw = trees.transform(_assembled(curve_on)).select(vector_to_array("probability")[1].alias("raw"), "label")
    points = (
        raw.groupBy(F.round(F.col("raw") * BINS).alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        .select("raw", "label", "weight")
    )
    if points.isEmpty():
        points = raw.sparkSession.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "raw double, label double, weight double")
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(points.coalesce(1))
    return Model(trees, curve, float(share))


def part_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 is held out (as are null ids), 1 and 2
    give the lexicon, 3 trains the trees, 4 the curve."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0)).cast("int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row of ``docs``.

    ``labels`` has the id and ``toxic``; null labels teach nothing, repeated rows
    count as often as they occur. Null and empty texts are scored like any other.
    Without labelled rows of both kinds every score is the share of label 1. An
    empty table gives an empty one. ``key_col``: a further column of ``docs`` to
    return with the row."""
    key = key_col or id_col
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.col(key).alias("key")).alias("row"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("lid"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    # the labels of a bounded sample are sent to the texts, so no text is shuffled to meet them
    draw = Window.partitionBy("label").orderBy(F.xxhash64("lid"), "lid")
    chosen = marked.where(part_of("lid").isin(1, 2)).distinct().withColumn("nth", F.row_number().over(draw)).where(F.col("nth") <= LEXICON_DOCS)
    sample = named.join(F.broadcast(chosen.drop("nth")), F.col("row.id") == F.col("lid"))  # 2 * LEXICON_DOCS rows sent
    lexicon = learn_lexicon(sample.select("row.id", "text", "label"))
    feats = store(featurize(named, "row", "text", lexicon), "features")
    train = store(
        feats.where(part_of("row.id") > 2).join(marked, F.col("row.id") == F.col("lid")).select("f", "label", part_of("row.id").alias("part")),
        "labelled",
    )
    model = fit(train.where("part = 3"), train.where("part = 4"))
    scored = model.score(feats, "row")
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return scored.select(
        F.col("row.id").alias(id_col),
        *([F.col("row.key").alias(key)] if key_col else []),
        (part_of("row.id") == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )

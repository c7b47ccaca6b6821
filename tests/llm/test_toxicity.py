"""Toxicity: feature arrays against a plain version, the learned lexicon against
counts, accuracy on held-out rows of words in no list, odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.llm import toxicity
from faultlens.llm.queries import REGISTRY

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LEARNED = [(0, b"grob", 3.0), (4, b"achl", 2.6), (5, "réeu".encode(), 4.0), (0, b"mild", 1.2), (3, b"mil", 1.1)]


def plain(text, learned=LEARNED):
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = WORD.findall(low)
    n, chars = max(len(words), 1), max(len(raw.decode()), 1)
    insults, you = ({w.encode() for w in s} for s in (toxicity.LEXICON, toxicity.SECOND_PERSON))
    hit = [i for i, w in enumerate(words) if w in insults]
    yours = [i for i, w in enumerate(words) if w in you]
    weight = [max([0.0, *(x for k, t, x in learned if (w == t if not k else len(w) > k and w[:k] == t))]) for w in words]
    strong = [i for i, x in enumerate(weight) if x >= toxicity.STRONG]
    near = lambda at: sum(any(abs(i - j) <= toxicity.NEAR for j in yours) for i in at)
    letters = [c for c in raw if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128]
    share = lambda chosen: sum(c in chosen for c in raw) / chars
    return {
        "words": len(words), "mean_word": sum(map(len, words)) / n, "hits": len(hit), "hit_rate": len(hit) / n,
        "distinct_hits": len({words[i] for i in hit}), "hits_in_100": max([sum(i <= j < i + 100 for j in hit) for i in hit], default=0),
        "near_you": near(hit), "near_share": near(hit) / max(len(hit), 1), "you_rate": len(yours) / n,
        "capitals": sum(65 <= c <= 90 for c in letters) / max(len(letters), 1),
        "exclaims": share(b"!"), "questions": share(b"?"), "digits": share(b"0123456789"), "symbols": share(b"#$%&*+@^_`"),
        "punctuation": share(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])),
        "learned_max": max(weight, default=0.0), "learned_hits": len(strong), "learned_rate": len(strong) / n,
        "learned_distinct": len({words[i] for i in strong}), "learned_near": near(strong),
        "mild_rate": sum(x >= toxicity.MILD for x in weight) / n, "learned_mean": sum(weight) / n,
    }


def test_feature_rows_equal_a_plain_version():
    rng = random.Random(2)
    parts = ["idiot", "you", "YOU", "dich", "grob", "Grob!", "achlich", "achl", "réeuxpa", "RÉEU", "mild", "milder", "tree", "a1", "7",
             "$$$", "?!", "\n", "TRASH", "tú", "é", "日本", "\U0001f600", "x_y"]
    texts = ["", " \t", "idiot", "you idiot", "idiot" + " x" * 300 + " you trash", "réeu", "you"]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 250))) for _ in range(40)] + [" ".join(parts * 900)]
    raws = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    got = toxicity.feature_rows(np.frombuffer(b"".join(raws), np.uint8), off, toxicity.Lexicon(LEARNED))
    for t, row in zip(texts, got, strict=True):
        for name, want in plain(t).items():
            assert row[toxicity.FEATURES.index(name)] == pytest.approx(want if t else 0.0, abs=1e-12), (name, t[:60])
    assert toxicity.features(texts[9], toxicity.Lexicon(LEARNED)) == pytest.approx(got[9].tolist())
    bare = toxicity.feature_rows(np.frombuffer(b"".join(raws), np.uint8), off)
    assert not bare[:, [i for i, c in enumerate(toxicity.FEATURES) if c.startswith(("learned", "mild"))]].any()


@pytest.mark.parametrize("slice_bytes", [64, 1 << 20])
def test_lexicon_equals_counts(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(toxicity, "_SLICE", slice_bytes)
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [rng.choice(["tree", "House", "été", "achs"]) for _ in range(6)]
        words += [f"Achl{rng.choice('aeiou')}{rng.randint(0, 9)}"] * 3 if i % 3 == 0 else ["calm"]
        rows.append((i, " ".join(words) if i % 50 else None, int(i % 3 == 0)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "id long, text string, label int").repartition(4))
    seen = {0: Counter(), 1: Counter()}
    for _, t, y in rows:
        words = set(WORD.findall((t or "").lower().encode()))
        seen[y].update({(0, w) for w in words} | {(k, w[:k]) for w in words for k in toxicity.STARTS if len(w) > k})
    n = Counter(y for _, _, y in rows)
    want = {}
    for term in set(seen[0]) | set(seen[1]):
        a, b = seen[1][term] + 0.5, seen[0][term] + 0.5
        w = math.log(a / (n[1] + 1)) - math.log(b / (n[0] + 1)) - math.sqrt(1 / a + 1 / b)
        if seen[0][term] + seen[1][term] >= toxicity.SEEN and w >= toxicity.MILD:
            want[term] = w
    found = {(k, t): w for k, (terms, weights) in got.parts.items() for t, w in zip(terms, weights, strict=True)}
    assert found.keys() == want.keys() and all(found[t] == pytest.approx(want[t]) for t in want)
    assert (4, b"achl") in want and (0, b"tree") not in want


def test_toxic_documents_without_a_listed_word(spark):
    """Marks that are beginnings of made-up words, in no list: held-out rows are told
    apart, and ids, labels or sources are no input."""
    rng = random.Random(11)
    ends = ["a", "ung", "eux", "ment", "o", "is", "era", "ó"]
    calm = [s + e for s in ("lorn", "tavi", "mel", "quor", "éba") for e in ends]
    rude = [s + e for s in ("grakk", "vüsch") for e in ends]
    text = lambda bad: " ".join(rng.choice(rude if bad and rng.random() < 0.1 else calm) for _ in range(50))
    rows = [(i, text(i % 4 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in rows], "doc_id long, text string, label string, f double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows if i % 7], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted for i in held if i % 4 == 0]) > 0.9
    assert np.mean([got[i].predicted for i in held if i % 4]) < 0.03
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.part_of() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_held_out_rows_of_a_given_table(spark):
    sf = "/root/testdata/sf0.01"
    scored = REGISTRY["op1_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = scored.select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(caught) >= 0.8 and np.mean(clean) <= 0.05


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 0
    one = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, only).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(one, only).collect())

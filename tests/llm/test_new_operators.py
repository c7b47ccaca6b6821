"""Hard negatives, mixing and spelling variants against brute-force versions, on
tables with nulls, ties, repeated rows and clashing column names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.llm import hard_negatives, mixing, spelling
from faultlens.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
CLASH = "word string, n long, size long, score double, leaf long, piece long, aid long, low string, place long, target double, extra int"
VALUES = ("w", 1, 2, 0.5, 3, 4, 5, "l", 6, 0.25, 7)


# --- hard negatives ---------------------------------------------------------


def vectors_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, x, *VALUES) for i, v, x in rows], "vec_id long, embedding array<float>, label int, " + CLASH).repartition(parts)


def brute_negatives(rows, every, positives=5, negatives=3):
    use = [(i, np.floor(np.array(v, np.float64) * 256), x) for i, v, x in rows
           if i is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    anchors = {(i, tuple(q), x) for i, q, x in use if i % every == 0}
    out = []
    for a, q, x in anchors:
        score = lambda p: int(sum(s * t for s, t in zip(q, p, strict=False)))  # noqa: B023, E731
        others = sorted(((-score(p), i, y) for i, p, y in use if i != a))
        for s, i, _ in [o for o in others if o[2] == x][:positives]:
            fits = [o for o in others if o[2] != x and 50 * -s <= 100 * -o[0] <= 95 * -s][:negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    unit = lambda c, w: [float(np.float32(x + w * rng.gauss(0, 1))) for x in c]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, unit(centres[i % 5], 0.6), i % 3) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.25, 0.0], i % 2) for i in range(400, 460)]  # one vector many times: ties
    rows += [rows[7], rows[7], rows[10], (10, unit(centres[0], 0.6), 1), (11, [1.0, 2.0], 0), (600, [2.0] * 9, 1)]
    rows += [(None, [1.0] * 6, 1), (700, None, 1), (710, [1.0, None] * 3, 1), (720, [float("nan")] * 6, 1), (730, [float("inf")] * 6, 1)]
    return rows + [(740, [1.0] * 6, None), (750, [], 0), (760, [0.0] * 6, 2), (770, [-9.0] * 6, 2)]


@pytest.mark.parametrize("sizes", [{}, {"sample": 120, "piece": 20, "fan": 3, "least": 8}])
def test_hard_negatives(spark, vectors, sizes):
    got = hard_negatives.hard_negatives(vectors_of(spark, vectors), F.col("vec_id") % 10 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == brute_negatives(vectors, 10)
    assert len(rows) > 100


def test_hard_negatives_of_nothing(spark):
    anchor = F.col("vec_id") % 10 == 0
    assert hard_negatives.hard_negatives(vectors_of(spark, []), anchor).count() == 0
    alone = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 3)]  # no other label
    assert hard_negatives.hard_negatives(vectors_of(spark, alone), anchor).count() == 0


def test_tree_eliminates_and_loses_nothing(spark):
    """On clustered rows of about one norm, as embeddings are, most leaves are ruled out,
    and every row of the annulus is in a leaf that is not."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    centres *= 256 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 8)
    top = float((rows**2).sum(axis=1).max())
    tree = hard_negatives.Tree(rows[:1000], top)
    leaf = tree.leaves(rows)
    slots = {}
    for x in np.unique(leaf):
        for node, child, i, lo, hi in tree.slots(int(x), rows[leaf == x]):
            a, z = slots.get((node, child, i), (lo, hi))
            slots[node, child, i] = min(a, lo), max(z, hi)
    tree.learn((*k, *v) for k, v in slots.items())
    queries = rows[::50]
    scores = queries @ rows.T
    high = np.sort(scores, axis=1)[:, [-20]]
    low = np.sort(scores, axis=1)[:, [-60]]
    met = {int(x): set(who.tolist()) for x, who in tree.visit(queries, low, high)}
    inside = (scores >= low) & (scores <= high)
    for q, r in zip(*np.nonzero(inside), strict=True):
        assert q in met[int(leaf[r])]
    seen = sum(len(who) * int((leaf == x).sum()) for x, who in met.items())
    assert seen < 0.3 * scores.size


# --- mixing -----------------------------------------------------------------


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, *VALUES) for i, t, s in rows], "doc_id long, text string, source string, " + CLASH).repartition(parts)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows, weights=(1, 2, 3), most=3):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size_of(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        fair = {s: most * sizes[s] if s in full else left * weight[s] / share for s in order}
        over = {s for s in order if s not in full and fair[s] > most * sizes[s]}
        if not over:
            return sizes, fair
        full |= over


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "bc", "dé", "x y"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), "big") for i in range(120)]
    rows += [(200 + i, "same words here", "big") for i in range(60)]  # one length, equal texts
    rows += [(300 + i, text(rng.randint(1, 9)), rng.choice(["b", "Z", "é", "￿", "\U0001f600", ""])) for i in range(60)]
    rows += [(400 + i, text(rng.randint(1, 9)), None) for i in range(5)] + [(500, text(30000), "long"), (501, text(900), "long")]
    rows += [(600, None, "none"), (601, "", "none"), (602, " \t\n", "none"), (None, text(7), "b"), (300, "again", "b")]
    return rows + [rows[0], rows[0], (None, None, None)]


def test_mixing(spark, texts):
    got = mixing.mix(docs_of(spark, texts)).collect()
    sizes, goal = brute_targets(texts)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size_of(t)) for i, t, s in texts)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source], rel=1e-12)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in taken.items():  # "long" has two documents: nothing nearer than one of them
        assert abs(t - goal[s]) <= 1 or s == "long"
    again = mixing.mix(docs_of(spark, texts[::-1], parts=7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = mixing.mix(docs_of(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_counts_hit_every_budget_that_can_be_hit():
    rng = random.Random(6)
    for trial in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 6))), np.int64)
        counts = np.array([rng.randint(1, 4) for _ in lengths], np.int64)
        budget = rng.randint(0, int((lengths * counts).sum()))
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        free = mixing._reach(lengths, counts, budget)
        assert (free >= 0).all() and (free <= counts).all()
        assert abs(int((free * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
        taken = mixing.fit_counts(lengths, counts, budget, window=16 if trial % 2 else 1 << 16)
        assert (taken >= 0).all() and (taken <= counts).all()


def test_counts_of_a_large_source():
    lengths = np.arange(1, 20001, dtype=np.int64)
    counts = np.full(20000, 1000, np.int64)
    whole = int((lengths * counts).sum())
    for budget in (1, 12345, whole // 3 + 7, whole - 1):
        assert int((mixing.fit_counts(lengths, counts, budget) * lengths).sum()) == budget
    even = np.array([100000, 300000], np.int64)  # longer than the window
    assert int((mixing.fit_counts(even, np.array([5, 5]), 1_070_000) * even).sum()) in (1_000_000, 1_100_000)


# --- spelling variants ------------------------------------------------------


def brute_variants(rows, least_length=5, least_count=3, every=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    n = {w: c for w, c in n.items() if c >= least_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    links = {w: sorted((-n[v], v) for v in n if near(w, v)) for w in n}
    form = {w: links[w][0][1] if links[w] and -links[w][0][0] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(links[w]), n.get(form[w])) for w in n), key=repr)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    stems = ["banana", "letter", "ÉTUDEs", "straßen", "bananas", "aaaaa", "aaaaaa", "abcdefghijkl", "mississippi", "quick"]
    words = []
    for w in stems:
        words += [w] * rng.randint(3, 40)
        for _ in range(25):
            k = rng.randrange(len(w) + 1)
            words += [w[:k] + rng.choice("abeé") + w[k + rng.randint(0, 1) :]] * rng.randint(1, 12)
            words += [(w[:k] + w[k + 1 :]).upper()] * rng.randint(1, 6)
    words += ["".join(rng.choice("ab") for _ in range(rng.randint(5, 7))) for _ in range(600)]  # crowded signatures
    words += ["z" * 3000] * 3 + ["z" * 2999] * 9
    rng.shuffle(words)
    rows = [(i, "".join(w + rng.choice([" ", ", ", "1", "\n", "-"]) for w in words[i::40])) for i in range(40)]
    return rows + [rows[0], rows[0], (None, rows[1][1]), (90, None), (91, ""), (92, " 123 Ωmega ĀĀĀĀĀ")]


def test_spelling(spark, spelled):
    docs = spark.createDataFrame([(i, t, *VALUES) for i, t in spelled], "doc_id long, text string, " + CLASH).repartition(5)
    got = spelling.variants(spelling.vocabulary(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_variants(spelled)
    assert sum(r.form is not None for r in got) > 30 and any(r.root != (r.form or r.word) for r in got)


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = spelling.variants(spelling.vocabulary(docs))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.count() == 0


def test_signatures_meet_within_two_dimensions():
    rng = random.Random(9)
    dims = spelling.Letters()
    for _ in range(500):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(5, 9)))
        k, c = rng.randrange(len(w)), rng.choice("abcdefg")
        for v in (w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]):
            (a, m), (b, o) = spelling.signatures(w, dims), spelling.signatures(v, dims)
            assert any(x == y for x, y in zip(a, b, strict=True)) and (m ^ o).bit_count() <= 2


# --- the registered queries -------------------------------------------------


def test_queries_on_given_tables(spark):
    mixed = REGISTRY["op12_mixing"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes, goal = brute_targets([tuple(r) for r in docs])
    got = {r.doc_id: r for r in mixed.collect()}
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == len(docs)
    taken = Counter()
    for r in docs:
        assert got[r.doc_id].size == size_of(r.text) and got[r.doc_id].taken <= 3 * size_of(r.text)
        taken[r.source] += got[r.doc_id].taken
    for s, t in taken.items():
        assert abs(t - goal[s]) <= max(1, 0.01 * goal[s])

"""Each operator against a brute-force version on small tables that hold nulls,
empty texts, repeated rows and ids, ties and clashing column names."""

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.llm import decontaminate, html_text, langid, packing, repeats, secret_scan, simhash, token_counts, topk, toxicity
from faultlens.llm.components import connected_components
from faultlens.llm.queries import REGISTRY, encoder
from faultlens.llm.tokenizer import counting

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, score double, fp long, key string, block long, row int, gone string, items string"
EXTRA = (0.5, 7, "k", 1, 2, "g", "i")


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOC).repartition(parts)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    rows += [(10, base[0]), (10, base[0]), (11, base[0] + " x"), (12, "q " + base[1][100:260] + " " + base[2])]
    rows += [(13, None), (14, ""), (15, " \t\n"), (None, base[3]), (16, "a" * 300), (17, "a" * 60), (18, text(1500)), (9, base[4][:49])]
    rows += [(10, base[5] + " other text under a known id"), (None, None), (19, "\x00\x01 ünïcode 日本語 \U0001f600")]
    return rows


def by_id(df, *columns):
    found = {}
    for r in df.select("doc_id", *columns).collect():
        found.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v, key=repr) for k, v in found.items()}


def expected(rows, f):
    found = {}
    for i, t in rows:
        found.setdefault(i, []).append(f(i, t or ""))
    return {k: sorted(v, key=repr) for k, v in found.items()}


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_repeats(spark, mixed, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "_SLICE", 500)
    n, first = repeats.LENGTH, {}
    for i, t in mixed:
        b = (t or "").encode()
        for p in range(len(b) - n + 1) if i is not None else ():
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)

    def one(i, t):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1) if i is not None else ():
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        return len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()

    got = repeats.remove_repeats(docs_of(spark, mixed))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected(mixed, one)
    assert sum(r.n_removed for r in got.collect()) > 500


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_repeats_compare_bytes_where_hashes_collide(spark, monkeypatch, block):
    """With one code for all bytes every two strings have the same hash."""
    monkeypatch.setattr(repeats, "CODES", 1)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    same = "the very same passage of more than fifty bytes, twice."
    unlike = "".join(chr(65 + i % 57) for i in range(120))
    rows = [(1, unlike), (2, "x" + same), (3, unlike[::-1]), (4, "ab" + same + "cd"), (5, same[::-1] + unlike[30:90]), (None, same)]
    got = by_id(repeats.remove_repeats(docs_of(spark, rows), keep_bytes=True), "kept")
    want = {i: t for i, t in rows} | {4: "abcd", 5: same[::-1]}
    assert got == {i: [(bytearray(t.encode()),)] for i, t in want.items()}


@pytest.mark.parametrize("block", [40, 1 << 20])
@pytest.mark.parametrize("buckets", [1 << 30, 16])
def test_repeats_where_the_smallest_document_goes_on_otherwise(spark, monkeypatch, block, buckets):
    """A string of document 1 whose longer forms are first in documents 2 and 3."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", buckets)
    same = "".join(chr(33 + (7 * i * i + 3 * i) % 89) for i in range(55))
    ends = ["".join(chr(97 + (i * k + k) % 26) for i in range(30)) for k in (3, 5, 7)]
    rows = [(1, same + ends[0]), (2, same + ends[1]), (3, same + ends[2]), (4, same + ends[1]), (5, "-" + same + ends[2] + "+")]
    got = by_id(repeats.remove_repeats(docs_of(spark, rows), keep_bytes=True), "kept")
    want = {1: rows[0][1], 2: ends[1], 3: ends[2], 4: "", 5: "-+"}
    assert got == {i: [(bytearray(t.encode()),)] for i, t in want.items()}


def test_repeats_returns_kept_bytes(spark):
    same = "the very same passage of more than fifty bytes, twice."
    got = by_id(repeats.remove_repeats(docs_of(spark, [(1, same), (2, "a" + same + "b")]), keep_bytes=True), "kept")
    assert got == {1: [(bytearray(same.encode()),)], 2: [(bytearray(b"ab"),)]}


def near_components(fps):
    ids = sorted(fps)
    label = {x: x for x in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("bucket", [1, 32])
def test_near_pairs_keep_all_components(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):  # chains of close fingerprints, and some three bits away
            fps.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    pairs = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_pairs(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    want = near_components(fps)
    edges = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "u long, v long")
    got = {r.node % 2**64: r.label for r in connected_components(edges).collect()}
    groups = lambda d: sorted(sorted(x for x in d if d[x] == v) for v in set(d.values()))
    alone = {x: ("alone", x) for x in fps - set(got)}
    assert groups(got | alone) == groups(want)


def test_simhash(spark, mixed):
    import xxhash

    def fingerprint(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = simhash.near_duplicates(docs_of(spark, mixed)).collect()
    fps = {(r.doc_id, r.fp % 2**64) for r in got}
    assert fps == {(i, fingerprint(t or "")) for i, t in mixed} and len(got) == len(mixed)
    label = near_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    assert all(r.component_id == least.get(label[r.fp % 2**64]) for r in got)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    hub = [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (500, None)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(300)}


def test_decontamination(spark, mixed, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 400)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [(1, mixed[0][1][20:200]), (2, "Ünïcode 日本語"), (3, None), (4, "..."), (5, mixed[2][1]), (6, "nowhere to be found"), (None, mixed[1][1]), (7, "a b")]
    windows = {}
    for i, t in items:
        w = words(t or "")
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if i is not None and n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))

    def one(_, t):
        w = words(t)
        hit, found = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        return len(w), len(hit), sorted(found)

    docs = docs_of(spark, mixed + [(20, "A.B a-b")])
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = expected(mixed + [(20, "A.B a-b")], one)
    index = decontaminate.build_index(docs)
    assert by_id(decontaminate.phrase_hits(index, frame), "n_words", "n_hit", "items") == want
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 200)  # the items go in several passes
    assert by_id(decontaminate.phrase_hits(index, frame), "n_words", "n_hit", "items") == want


def test_proximity(spark):
    docs = docs_of(spark, [(1, "beta x alpha y gamma"), (2, "alpha beta"), (3, "gamma z z z z alpha beta"), (4, "alpha"), (5, "gamma beta alpha")])
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = by_id(decontaminate.phrase_hits(decontaminate.build_index(docs), items, span=5), "items")
    assert {k for k, v in got.items() if v == [(["9"],)]} == {1, 5}


def test_secret_scan_and_ledger(spark):
    rows = [
        (1, 'x token = "abcdef12" y'), (2, "AKIA" + "B" * 16 + " AKIA" + "C" * 15), (3, "deadbeef" * 3 + "g" + "ab" * 11), (4, None), (5, ""),
        (6, "secret:token : abcdefgh"), (7, 'é\U0001f600 API_KEY:"' + "f" * 30 + '"'), (8, 'x token = "abcdef12" y'), (None, "passwd=longenough"),
        (1, "password=123456 password=12345 PaSsWd : 'zzzzzz'"), (9, "\x01token=abcdefg\x01"),
    ]
    patterns = [(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "assign"),
                (r"AKIA[A-Z0-9]+", 0, 20, "access"), (r"[0-9a-f]+", 0, 24, "hex")]

    def one(_, t):
        out = [(m.start(), k, m.end(), kind) for k, (p, g, n, kind) in enumerate(patterns) for m in re.finditer(p, t) if len(m[g]) >= n]
        return (",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(out)),)

    docs = docs_of(spark, rows)
    found, ledger = secret_scan.scan(docs)
    got = found.withColumn("spans", secret_scan.joined(secret_scan.base("spans")))
    assert by_id(got, "spans") == expected(rows, one)
    # the same versions again: nothing is scanned; a new rule version scans every blob with that rule alone
    assert by_id(secret_scan.scan(docs, ledger)[0].withColumn("spans", secret_scan.joined("spans")), "spans") == by_id(
        found.withColumn("spans", secret_scan.joined("spans")), "spans"
    )
    more = (*secret_scan.RULES, secret_scan.Rule("word", "token", 0, 1, "token"))
    again, newer = secret_scan.scan(docs_of(spark, rows + [(30, "a token")]), ledger, rules=more)
    assert by_id(again.where("doc_id = 30").withColumn("spans", secret_scan.joined("spans")), "spans") == {30: [("word:2:7",)]}
    assert newer.count() == ledger.count() + 1
    assert all(sorted(r.rules) == sorted(x.key for x in more) for r in newer.collect())
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ledger_keeps_rule_versions_apart(spark):
    first = (secret_scan.Rule("key", "k[0-9]+", 0, 1, "k"), secret_scan.Rule("word", "token", 0, 1, "token"))
    second = (first[1], secret_scan.Rule("key", "k[0-9]{2,}", 0, 1, "k", version=2))
    spans = lambda found: {r.doc_id: r.spans for r in found.select("doc_id", secret_scan.joined("spans").alias("spans")).collect()}
    docs = docs_of(spark, [(1, "k1 k22 token"), (2, "k3")])
    found, ledger = secret_scan.scan(docs, rules=first)
    assert spans(found) == {1: "key:0:2,key:3:6,word:7:12", 2: "key:0:2"}
    found, ledger = secret_scan.scan(docs, ledger, rules=second)
    assert spans(found) == {1: "key:3:6,word:7:12", 2: ""}
    assert [[s.ord for s in r.spans] for r in found.where("doc_id = 1").collect()] == [[2, 1]]
    assert spans(secret_scan.scan(docs, ledger, rules=first)[0]) == {1: "key:0:2,key:3:6,word:7:12", 2: "key:0:2"}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20)).round(2)
    base[7] = base[8] = base[9]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100, None), (101, [1.0, None] + [0.0] * 18), (102, [float("nan")] + [0.0] * 19), (103, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1]), (104, []), (14, rows[14][1]), (30, rows[9][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, frame.where("vec_id % 7 = 0"), candidates=16, query_rows=3)
    q = np.floor(base * 256).astype(int)
    want = []
    held = [(i, q[i]) for i in range(60)] + [(5, q[5]), (14, q[14]), (30, q[9])]  # repeated rows are candidates each
    for i in range(0, 60, 7):
        own = [v for j, v in held if j == i]  # a query that occurs twice has every candidate twice
        best = sorted((-int(v @ w), j) for v in own for j, w in held if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    clash = frame.withColumns({c: F.lit(1) for c in ("block", "dims", "ids", "n", "v", "score", "rank")})
    again = topk.top_k(clash, clash.where("vec_id % 7 = 0"))
    assert sorted(tuple(r) for r in again.collect()) == sorted(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>{top}
<article><h1>Title &amp; more</h1><p>First <b>bold</b>text&nbsp;here.<p>Second
 line<br>after<form><input>Name</form><ul><li>one<li>two</ul><div class="comments"><p>I disagree</p></div>
<section class="x"><p>{body}</p></section></article><aside>Side</aside><footer>&copy; host</footer></body></html>"""


def test_html(spark):
    plain = "<body><div id='a'>Menu of the site</div><div><p>Own text {n} &lt;x&gt;</p></div><div>All rights</div></body>"
    rows = [(i, f"http://u@h.example:80/{i}", PAGE.format(top="", body=f"same body")) for i in range(6)]
    rows += [(10 + i, f"https://Plain.example/{i}", plain.format(n=i)) for i in range(8)]
    rows += [(30, None, None), (31, "x", ""), (32, "http://one.example", plain.format(n=9)), (None, "http://z.example", "<p>a<p>b &#x41;"), (33, "", "no markup")]
    got = {}
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    article = "Title & more First boldtext here. Second line after one two same body"
    want = {i: [article] for i in range(6)} | {10 + i: [f"Own text {i} <x>"] for i in range(8)}
    want |= {30: [""], 31: [""], 32: ["Menu of the site Own text 9 <x> All rights"], None: ["a b A"], 33: ["no markup"]}
    assert got == want


UNNAMED = """<html><body>Top of site<div class="x{n}"><span>Menu {v}</span><p>Item {v}<p>Item {n}</div>{odd}
<article><h1>Title {n}</h1><p>Same<p>Own {n}<br>line</article><section><p>Rotating {v}</section>Bottom {v}</body></html>"""


def unnamed_pages():
    """Pages whose furniture has no telling name: menus and ends rotate, and differ on each page."""
    odd = lambda i: f"<table><tr><td>Odd {i}</table>" if i == 7 else ""
    rows = [(i, f"http://hot.example/{i}", UNNAMED.format(n=i, v=i % 9, odd=odd(i))) for i in range(48)]
    rows += [(100 + i, f"http://small.example/{i}", UNNAMED.format(n=i, v=0, odd="")) for i in range(3)]
    return rows + [(200, "http://one.example/", UNNAMED.format(n=1, v=0, odd="<table><tr><td>Odd</table>"))]


def test_html_templates_are_counted_on_every_host(spark):
    """Recurring content and shapes outside the article go whatever they are called and
    however many pages the host has; on a host of one page all that is outside goes."""
    frame = spark.createDataFrame(unnamed_pages(), "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    own = {r[0]: f"Title {i} Same Own {i} line" for r in unnamed_pages() for i in [1 if r[0] == 200 else r[0] % 100]}
    assert got == own | {7: "Odd 7 " + own[7]}  # what is on one page only, in a shape of its own, is no template


def test_html_equals_a_plain_count(spark):
    """Random pages: subtrees counted and deleted one by one, page by page."""
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return word()
        tag = rng.choice(["div", "section", "p", "ul", "span"])
        label = rng.choice(["", " class='a'", " class='b7'", " id='c'"])
        return f"<{tag}{label}>" + " ".join(tree(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    pages = []
    for i in range(60):
        root = f"<article><p>{word()} {i}<p>{tree(2)}</article>" if i % 3 else tree(3)
        pages.append((i, f"http://h{i % 5}.example/{i}" if i != 59 else "http://alone.example", f"<body>{tree(3)}{root}{tree(2)}</body>"))
    pages.append(pages[4])
    parsed, counts, sizes = [], {}, {}
    for i, url, page in pages:
        host = url.split("/")[2]
        blocks, own, out, nodes = html_text.parse(page)
        parsed.append((i, host, blocks, own, out, nodes))
        sizes[host] = sizes.get(host, 0) + 1
        for h in {n[0] for n in nodes}:
            counts[host, h] = counts.get((host, h), 0) + 1
    want = {}
    for i, host, blocks, own, out, nodes in parsed:
        gone = list(own) + (list(out) if sizes[host] == 1 else [])
        for h, a, z in nodes:
            n, share = counts[host, h], html_text.MIN_SHARE * sizes[host]
            least = {html_text.CONTENT: 2, html_text.SHAPE: max(2, share), html_text.IN_ROOT: max(html_text.MIN_PAGES, share)}[h & 3]
            if n >= least:
                gone.append((a, z))
        want.setdefault(i, []).append(" ".join(b for k, b in enumerate(blocks) if not any(a <= k < z for a, z in gone)))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {}
    for r in html_text.main_text(frame).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == want and len({t for x in want.values() for t in x}) > 40


def test_html_subtrees_are_marked_once_a_page(spark, monkeypatch):
    """Subtrees of a row are not compared pair by pair, nor exploded beside the row's hosts."""
    page = "<html><body>" + "<div><b>Menu</b></div>" * 3 + "<div><b>Other</b></div></body></html>"
    frame = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", page) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    rows = html_text.parsed(frame)
    nodes = rows.select(F.explode("nodes").alias("n")).select("n.*").collect()
    assert len({(r.i, r.hash) for r in nodes}) == sum(r.once for r in nodes) < len(nodes)
    plans, store = [], html_text.store
    monkeypatch.setattr(html_text, "store", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, name))
    html_text.templates(rows)
    assert "array_distinct" not in plans[0] and "explode" in plans[0]


def test_html_of_an_empty_table_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, row long, hosts string, nodes int, text string, hash long"
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "http://a.example", "<p>x", 1, "h", 2, "t", 3)], schema)
    assert [tuple(r) for r in html_text.main_text(one).collect()] == [(1, "http://a.example", "x")]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<script>var a='<article>'</script><main><p>Main text</main><p>Outside", "Main text"),
        ("<!-- <article> --><div><p>Body text</div>", "Body text"),
        ("<article-list></article-list><mainmenu></mainmenu><div>Body text</div>", "Body text"),
        ("<main><p>Main text of some length</main><aside><article>A card</article></aside>", "Main text of some length"),
        ("<article>x</article><div><p>All of the text stands in here</div>", "x All of the text stands in here"),
        ("<article><svg class='i' d=\"a>b\"/><p>After</p><svg><text>no</text></svg><p>End</article>", "After End"),
        ("<title-bar>Bar</title-bar><style-guide>Guide</style-guide><p>Text", "Bar Guide Text"),
        ("<article><h2 id='related-work'>Related work</h2><section class='social-history'><p>Own</section><div class='share'>no</div></article>", "Related work Own"),
    ],
)
def test_html_main_text_of_ordinary_markup(page, want):
    blocks, own, out, _ = html_text.parse(page)
    own += out
    assert " ".join(b for i, b in enumerate(blocks) if not any(a <= i < z for a, z in own)) == want


def test_token_trees_and_edits(spark, mixed):
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = counting(encoder())
    n = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    many = {i: [(rng.randint(0, 400), rng.randint(0, 30), rng.choice(["", " a", "b c  d", None, "\n"])) for _ in range(6)] for i in range(20)}
    # a row per edit list; null ids and repeats share them
    state = token_counts.trees(docs_of(spark, mixed), count)
    listed = spark.createDataFrame([(i, [dict(at=a, cut=c, put=p) for a, c, p in e]) for i, e in many.items()], f"eid long, edits {token_counts.EDITS}")
    got = token_counts.apply_edits(state.join(listed, F.col("doc_id") == F.col("eid"), "left"), count)

    def one(i, t):
        new = t
        for a, c, p in many.get(i, ()):
            a = min(a, len(new))
            new = new[:a] + (p or "") + new[a + c :]
        return n(t), n(new), len(new), new

    shown = got.select("doc_id", "before", F.col("tokens")[1].alias("t"), F.col("chars")[1].alias("c"), "text")
    assert by_id(shown, "before", "t", "c", "text") == expected(mixed, one)


def test_encoder_equals_the_tokenizer_file():
    from tokenizers import Tokenizer

    import public_tokenizers

    own, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()()
    chars = [chr(c) for r in ((1, 0x600), (0x1E00, 0x2100), (0x3000, 0x3100), (0xFF00, 0xFF80)) for c in range(*r)]
    texts = [f"a{c}b {c}1{c} {c}{c}  {c}\n" for c in chars] + ["x<|endoftext|>y", "", "   ", "it's  we'll\n\n"]
    assert all(list(encode(t)) == own.encode(t, add_special_tokens=False).ids for t in texts)


def test_packing(spark, mixed):
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(packing.pieces(docs_of(spark, mixed), encoder())).collect()
    ids = lambda t: own.encode(t or "", add_special_tokens=False).ids + [2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = []
    for i, t in mixed:
        x = ids(t)
        cuts = [0, *range((len(x) - 1) % 1024 + 1, len(x) + 1, 1024)]
        want += [(i, k, a, z - a, crc(x[a:z])) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(docs_of(spark, mixed).limit(0), encoder())).count() == 0


@pytest.mark.parametrize("seed,groups", [(1, 1024), (2, 12), (3, 3)])
def test_packing_plan_covers_all_and_is_tight(seed, groups):
    rng = random.Random(seed)
    counts = {s: rng.choice([0, 1, 2, 50, 900]) for s in range(1, 1024)} if seed < 3 else {700: 5, 300: 9, 1: 4}
    rows = packing.plan(counts, n_groups=groups)
    taken, bins = {}, {}
    for length, rank, n, first, offset in rows:
        for i in range(n):
            taken.setdefault(length, []).append(rank + i)
            bins.setdefault(first + i, []).append((offset, length))
    assert {k: sorted(v) for k, v in taken.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    rooms = []  # best fit decreasing, piece by piece
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        k = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 1024) - s)
    assert len(bins) <= len(rooms) and len(rows) < 20_000


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = REGISTRY["op3_langid"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang == found.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()
    trees = langid.train(docs)
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "der die und einer"), (None, "é")])
    got = by_id(langid.predict(odd, trees), "lang_pred", "score")
    assert got[1] == got[2] == got[3] == [("und", 0.0)] and got[4][0][0] == "de" and got[None][0][0] != "und"
    nothing = langid.train(docs.limit(0))
    assert by_id(langid.predict(odd, nothing), "lang_pred")[4] == [("und",)]


def test_code_lengths_are_exact():
    """Table sums equal a walk down the context trees, byte by byte."""
    rng = random.Random(4)
    texts = {"x": [bytes(rng.choice(b"abc ") for _ in range(80)) for _ in range(4)], "y": [bytes(rng.choice(b"abd") for _ in range(50)) for _ in range(3)]}
    order = langid.ORDER

    def grams(rows):
        codes = np.concatenate([langid._codes(np.frombuffer(r, np.uint8)) for r in rows])
        return np.unique(codes, return_counts=True)

    trees = langid.Trees(["x", "y"], {k: grams(v) for k, v in texts.items()}).open()

    def counts(rows):
        seen = {}
        for r in rows:
            padded = bytes(order) + r
            for i in range(len(r)):
                for o in range(order + 1):
                    ctx = padded[i + order - o : i + order]
                    seen.setdefault(ctx, {}).setdefault(r[i], 0)
                    seen[ctx][r[i]] += 1
        return seen

    def walk(seen, r):
        bits, padded = 0.0, bytes(order) + r
        for i in range(len(r)):
            for o in range(order, -2, -1):
                if o < 0:
                    bits += 8
                    break
                ctx = seen.get(padded[i + order - o : i + order])
                if ctx is None:
                    continue
                n, kinds = sum(ctx.values()), len(ctx)
                if r[i] in ctx:
                    bits += np.log2((n + kinds) / ctx[r[i]])
                    break
                bits += np.log2((n + kinds) / kinds)
        return bits

    asked = [b"abc abd", b"", b"zzz\xff", b"a", texts["y"][0]]
    off = np.concatenate(([0], np.cumsum([len(a) for a in asked])))
    got = trees.code_lengths(np.frombuffer(b"".join(asked), np.uint8), off)
    for i, a in enumerate(asked):
        for j, lang in enumerate(("x", "y")):
            assert abs(got[i, j] - walk(counts(texts[lang]), a)) < 1e-3 * max(1, len(a))


def test_toxicity(spark):
    rng = random.Random(6)
    calm = ["tree", "house", "river", "walk", "green", "seven", "paper"]
    rude = ["idiot", "moron", "pathetic", "trash", "clown"]
    text = lambda bad: " ".join(rng.choice(rude if bad and rng.random() < 0.2 else calm) for _ in range(60))
    rows = [(i, text(i % 3 == 0)) for i in range(400)] + [(1000, None), (1001, ""), (None, "you idiot"), (0, text(True))]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows), labels).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(400) if got[i].held_out} == set(held)
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.95
    blank = toxicity.toxicity(docs_of(spark, rows), labels.limit(0)).collect()
    assert len(blank) == len(rows) and {r.score for r in blank} == {0.0}


def test_masked_insults_are_seen():
    at = toxicity.FEATURES.index("masked")
    assert [toxicity.features(t)[at] for t in ("you 1d10t", "m.o.r.o.n", "s t u p i d dog", "stuuuupid", "a nice day")] == [1, 1, 1, 1, 0]
    assert toxicity.features(None) == toxicity.features("") == [0.0] * len(toxicity.FEATURES)


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_repeats", "op5_secrets", "op6_decontaminate", "op8_token_counts", "op9_simhash"])
def test_queries_return_a_row_per_document(spark, name):
    df = REGISTRY[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op2_repeats", "op6_decontaminate", "op9_simhash", "op5_secrets"])
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert REGISTRY[name](spark, str(tmp_path)).count() == 0

"""Main text of web pages by site template removal.

Every page is parsed once, whole, into blocks of text and the element subtrees
above them. A subtree has two hashes: of its content (tags, classes and text) and
of its shape (tags and classes alone, runs of equal children as one, digits
alike). Spark counts the pages of a host that hold each, and subtrees that recur
are templates and are deleted, with all text below:

* outside the content root (``article``, else ``main``, where it holds enough of the
  text), if its content is on ``REPEATED`` pages of the host, or its shape on
  ``MIN_SHARE`` of them: menus, adverts and footers rotate, but keep their shape;
* in the root, or on a page without one, if its content is on ``MIN_PAGES`` and
  ``MIN_SHARE`` of the host's pages; no shape counts there, as paragraphs are alike.

Paragraphs inside the article are never taken for a template: copies of an
article on one host keep their text. What the markup itself names (forms, reader
comments, ...) goes too, and on a host of a single page, where nothing can recur,
the text outside the root.

Parsed pages are stored in rows of many pages, a table bucketed by row, so that
the answers are brought to the text and the text is never shuffled.
"""

from __future__ import annotations

import html
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import partitions, scratch_path, store

#: Pages of a host, and share of them, that make a subtree a template; outside the content
#: root REPEATED pages with the same content do.
MIN_PAGES = 5
MIN_SHARE = 0.3
REPEATED = 2
#: Kinds of a hash, its last two bits: content in the root (or without one), content and shape outside it.
IN_ROOT, CONTENT, SHAPE = 0, 1, 2
ROW_BYTES = 1 << 20

# Fixed values of HTML and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr ruby rt rp nobr img acronym".split()
)
DROP = frozenset(
    "head title dialog button select textarea input iframe object embed canvas svg template "
    "noscript script style audio video map applet datalist".split()
)
HINT = frozenset("nav footer aside form menu".split())
RAW = "script|style|noscript|template|iframe|textarea|title|xmp|noembed|noframes"
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead caption figcaption article main".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NAMED = frozenset(
    """
    nav navbar navigation menu breadcrumb breadcrumbs masthead topbar toolbar footer sidebar aside widget widgets
    ad ads advert adverts advertisement advertising adsbygoogle banner promo promotion promoted sponsor sponsored
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended pagination pager search comment comments commentlist reply replies disqus
    skip copyright disclaimer
    """.split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    # a self-closing icon has no end tag
    rf"|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?(?:</svg\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|([^\s"'=<>/]+)""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


#: Content roots, and what is kept whatever the root is.
ARTICLE, MAIN, ALWAYS = 1, 2, 4
#: A content root holds this share of the text that the markup does not name as no content.
MOST = 0.25
#: The hash under which every page of a host is counted.
PAGE = 0


class _Node:
    __slots__ = ("tag", "drop", "hint", "digest", "shape", "child", "first", "keep", "root", "inside")

    def __init__(self, tag: str, drop: bool, hint: bool, first: int, keep: int, root: int, inside: int):
        self.tag, self.drop, self.hint, self.first, self.keep, self.root, self.inside = tag, drop, hint, first, keep, root, inside
        self.digest, self.shape, self.child = xxhash.xxh64(), xxhash.xxh64(), 0


def _named(tag: str, raw: str, in_main: bool) -> tuple[str, bool, bool]:
    """The element's class and id, whether it is never shown, and whether its markup
    names it as no content."""
    if tag in DROP:
        return "", True, False
    hint = tag in HINT or (tag == "header" and not in_main)
    if not raw or tag in ("html", "body", "article", "main"):
        return "", False, hint
    attrs = {(a or c).lower(): b.strip("\"'") for a, b, c in _ATTR.findall(raw)}
    label = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip().lower()
    drop = "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    # words of a name tell furniture apart, but slugs of headings and sections are words too
    whole = in_main or tag in PROSE
    names = [*attrs.get("class", "").lower().split(), attrs.get("id", "").strip().lower()] if whole else _SPLIT.split(label)
    hint = hint or bool(NAMED.intersection(names)) or attrs.get("role", "").lower() in ROLES
    return label, drop, hint


def _ranges(flags: list[bool]) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.array([False, *flags, False], np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _signed(h: int, kind: int) -> int:
    return ((h & ~3) | kind) - (1 << 63)


def parse(page: str) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Blocks of text in page order; the ranges of them that the markup names as no
    content; those that stand outside the ``article`` (or else ``main``) where that
    holds enough of the text; and the subtrees that may be templates, each as (hash,
    first block, block after the last)."""
    blocks: list[str] = []
    hints: list[bool] = []
    roots: list[int] = []
    nodes: list[tuple[int, int, int, int, int, int]] = []
    buffer: list[str] = []
    stack: list[_Node] = []
    hidden = 0  # open elements that are not shown
    hinted = 0  # open elements that are named as no content
    inside = {ARTICLE: 0, MAIN: 0}  # open content roots

    def within() -> int:
        return (ARTICLE if inside[ARTICLE] else 0) | (MAIN if inside[MAIN] else 0)

    def flush():
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append(text)
                hints.append(hinted > 0)
                roots.append(within())
                raw = text.encode("utf-8", "surrogatepass")
                if stack:
                    stack[-1].digest.update(raw)
                if not stack or stack[-1].tag in ("html", "body"):  # text of no element of its own
                    h = xxhash.xxh64_intdigest(raw)
                    nodes.append((h, len(blocks) - 1, len(blocks), 0, 0, 0))

    def close():
        nonlocal hidden, hinted
        if stack[-1].tag not in INLINE or stack[-1].hint:
            flush()
        node = stack.pop()
        hidden -= node.drop
        hinted -= node.hint
        if node.root:
            inside[node.root] -= 1
        h, shape = node.digest.intdigest(), node.shape.intdigest()
        held = len(blocks) > node.first
        # an element around one subtree and nothing else recurs no more often than that
        if held and node.tag not in INLINE and (not nodes or nodes[-1][1:3] != (node.first, len(blocks))):
            nodes.append((h, node.first, len(blocks), node.keep, node.inside, shape))
        if stack:
            stack[-1].digest.update(b"<%d>" % h)
            if node.tag not in INLINE and shape != stack[-1].child:  # a run of equal children is one
                stack[-1].child = shape
                stack[-1].shape.update(b"<%d>" % shape)
            # what holds paragraphs of the article is no template either
            stack[-1].keep |= node.keep & ~ALWAYS if held else 0

    def text(s: str):
        if s and not hidden:
            buffer.append(s)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "br":
                text(" ")
            elif any(n.tag == tag for n in stack):
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag == "br":
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            own, scope = CLOSES[tag]
            cut = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in own or stack[i].tag in scope), None)
            if cut is not None and stack[cut].tag in own:
                while len(stack) > cut:
                    close()
        elif tag not in INLINE:  # a block ends an open paragraph
            cut = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p"), None)
            if cut is not None and not any(n.tag in ("button", "table", "object", "td", "th") for n in stack[cut:]):
                while len(stack) > cut:
                    close()
        raw = m.group(4) or ""
        if raw.endswith("/") and (tag in INLINE or tag == "svg"):
            continue
        label, drop, hint = _named(tag, raw, within() > 0)
        if hint and tag in INLINE:
            flush()
        hidden += drop
        hinted += hint
        around = within()
        own_root = {"article": ARTICLE, "main": MAIN}.get(tag, 0) if not hinted and not hidden else 0
        if own_root:
            inside[own_root] += 1
        keep = ALWAYS if tag in ("html", "body") else within() if tag in PROSE and not hinted else 0
        stack.append(_Node(tag, drop, hint, len(blocks), keep, own_root, around))
        stack[-1].digest.update(f"{tag}|{label}".encode("utf-8", "surrogatepass"))
        stack[-1].shape.update(f"{tag}|{_DIGITS.sub('0', label)}".encode("utf-8", "surrogatepass"))
    text(page[at:])
    flush()
    while stack:
        close()
    size = [0 if h else len(b) for b, h in zip(blocks, hints, strict=True)]
    share = {r: sum(n for n, x in zip(size, roots, strict=True) if x & r) for r in (ARTICLE, MAIN)}
    root = next((r for r, n in share.items() if n and n >= MOST * sum(size)), 0)
    out = _ranges([bool(root and not r & root) for r in roots])
    found = []
    for h, a, b, keep, inside, shape in nodes:
        if keep & (root | ALWAYS):
            continue
        if not root or inside & root:
            found.append((_signed(h, IN_ROOT), a, b))
        else:
            found.append((_signed(h, CONTENT), a, b))
            if shape:
                found.append((_signed(shape, SHAPE), a, b))
    return blocks, _ranges(hints), out, found


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of about ``ROW_BYTES`` of pages, stored in a table bucketed by ``row``: ids,
    urls, hosts and numbers of blocks by page, the blocks of all, and by page (``i``)
    and block of the row what the markup names (``own``), what stands outside the root
    (``out``) and the subtrees (``nodes``; ``once``: the first of its hash on its page)."""
    spark = pages.sparkSession
    kind = pages.select(page_id).schema[0].dataType
    span = [T.StructField("i", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]
    strings = T.ArrayType(T.StringType())
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("urls", strings)]
        + [T.StructField("hosts", strings), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("blocks", strings)]
        + [T.StructField(n, T.ArrayType(T.StructType(span))) for n in ("own", "out")] + [T.StructField("nodes", T.ArrayType(T.StructType([*span, T.StructField("hash", T.LongType()), T.StructField("once", T.BooleanType())])))]
    )

    kinds = {"hash": pa.int64(), "once": pa.bool_()}

    def spans(columns: list[list], names: tuple[str, ...]):
        values = [pa.array(x, kinds.get(n, pa.int32())) for x, n in zip(columns, names, strict=True)]
        return pa.StructArray.from_arrays(values, names=list(names))

    def run(batches):
        row = TaskContext.get().partitionId() << 32
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                hosts, sizes, blocks, held = [], [], [], 0
                own, out, nodes = ([], [], []), ([], [], []), ([], [], [], [], [])
                i = lo
                while i < b.num_rows and (i == lo or held < ROW_BYTES):
                    page = b.column(2)[i].as_py() or ""
                    found = _HOST.match(b.column(1)[i].as_py() or "")
                    hosts.append(found[1].lower() if found else "")
                    text, hints, outside, trees = parse(page)
                    for to, ranges in ((own, hints), (out, outside)):
                        for x, y in ranges:
                            for c, v in zip(to, (i - lo, x + len(blocks), y + len(blocks)), strict=True):
                                c.append(v)
                    seen = set()
                    for h, x, y in trees:
                        for c, v in zip(nodes, (i - lo, x + len(blocks), y + len(blocks), h, h not in seen), strict=True):
                            c.append(v)
                        seen.add(h)
                    sizes.append(len(text))
                    blocks += text
                    held += len(page)
                    i += 1
                cells = [b.column(0).slice(lo, i - lo), b.column(1).slice(lo, i - lo), pa.array(hosts, pa.string()), pa.array(sizes, pa.int32())]
                cells += [pa.array(blocks, pa.string()), spans(own, ("i", "a", "b")), spans(out, ("i", "a", "b")), spans(nodes, ("i", "a", "b", "hash", "once"))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in cells]
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists], names=schema.names)
                row += 1
                lo = i

    rows = pages.select(page_id, F.col(url).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, schema)
    name = f"llm_pages_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(2 * partitions(spark), "row").option("parquet.page.size.row.check.min", "1").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "pages")).option("parquet.block.size", str(8 << 20)).saveAsTable(name)
    return spark.table(name)


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, hash)`` of subtrees that recur across pages of their host, and ``PAGE`` as
    the hash of hosts with a single page."""
    # the parser marks the first of a hash: array_distinct compares structs pair by pair
    held = F.transform(F.filter("nodes", lambda n: n["once"]), lambda n: _of_host(n["i"], n["hash"]))
    own = rows.select(F.explode(F.concat(held, _pages())).alias("n")).select("n.host", "n.hash")
    counted = own.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= REPEATED) | (F.col("hash") == PAGE))
    counted = store(counted, "subtrees")
    hosts = counted.where(F.col("hash") == PAGE).select("host", F.col("n").alias("pages"))
    kind = F.col("hash").bitwiseAND(F.lit(3))
    share = F.lit(min_share) * F.col("pages")
    least = F.when(kind == CONTENT, F.lit(float(REPEATED))).when(kind == SHAPE, share).otherwise(F.greatest(F.lit(float(min_pages)), share))
    known = counted.where(F.col("hash") != PAGE).join(hosts, "host").where(F.col("n") >= least).select("host", "hash")
    return known.union(hosts.where("pages = 1").select("host", F.lit(PAGE).cast("bigint")))


def _of_host(i: Column, h: Column, *more: Column) -> Column:
    """A hash on page ``i`` of a row. Hosts are looked up in the row: exploded beside it,
    the list of all would be copied with each hash."""
    return F.struct(F.get("hosts", i).alias("host"), h.alias("hash"), *more)


def _span(i: Column, a: Column, b: Column) -> Column:
    return F.struct(i.alias("i"), a.alias("a"), b.alias("b")).alias("span")


def _pages(spans: bool = False) -> Column:
    """``PAGE`` for every page of a row."""
    none = F.lit(-1)
    return F.transform("hosts", lambda _, i: _of_host(i, F.lit(PAGE).cast("bigint"), *([_span(i, none, none)] if spans else [])))


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html",
    min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``(page_id, url, text)`` of every row, text empty if none is left. Null html is
    empty; pages without a host form a host of their own; repeated rows count as
    pages each and are all returned."""
    rows = parsed(pages, page_id, url, html_col)
    known = templates(rows, min_pages, min_share)
    held = F.transform("nodes", lambda n: _of_host(n["i"], n["hash"], _span(n["i"], n["a"], n["b"])))
    asked = rows.select("row", F.explode(F.concat(held, _pages(spans=True))).alias("n")).select("row", "n.host", "n.hash", "n.span")
    gone = asked.join(known, ["host", "hash"]).groupBy("row").agg(F.collect_list("span").alias("gone"))  # subtrees of one row's pages
    schema = T.StructType([pages.select(page_id).schema[0], T.StructField(url, T.StringType()), T.StructField("text", T.StringType())])

    def column(cells, name):
        return cells.field(name).to_numpy(zero_copy_only=False).astype(np.int64)

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {n: c[r].values for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                blocks, off = cell["blocks"], np.concatenate(([0], np.cumsum(cell["sizes"].to_numpy(zero_copy_only=False).astype(np.int64))))
                own, out = ([column(cell[x], c) for c in ("i", "a", "b")] for x in ("own", "out"))
                spans = [column(cell["gone"], c) if cell["gone"] is not None else np.zeros(0, np.int64) for c in ("i", "a", "b")]
                marked = spans[1] < 0  # the only pages of their hosts
                follow = np.isin(out[0], spans[0][marked])
                begin = np.concatenate((spans[1][~marked], own[1], out[1][follow]))
                end = np.concatenate((spans[2][~marked], own[2], out[2][follow]))
                edge = np.bincount(begin, minlength=len(blocks) + 1) - np.bincount(end, minlength=len(blocks) + 1)
                keep = np.cumsum(edge[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(keep)))[off]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), blocks.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([cell["ids"], cell["urls"], pc.binary_join(lists, " ")], names=schema.names)

    final = rows.select("row", "ids", "urls", "sizes", "blocks", "own", "out").join(gone, "row", "left")
    return final.drop("row").mapInArrow(cut, schema)

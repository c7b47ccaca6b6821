"""Removal of repeated substrings by longest previous factors.

A byte goes if a ``LENGTH``-byte string over it also starts in a document with a
smaller id: its longest previous factor, over the suffixes of all earlier
documents, has that length or more. In suffix order the suffixes that share a
``LENGTH``-byte prefix stand next to each other, and the nearest one of a
smaller document before or after a suffix (previous and next smaller value)
gives its longest previous factor. Whether that reaches ``LENGTH`` needs only
suffixes cut to that length, and only equal ones matter, so the order is that of
their hashes, built in pieces: equal prefixes meet in one bucket. Hashes only
propose; before anything goes, its bytes are compared with those of the nearest
smaller document.

Not every suffix travels. A prefix is represented by its anchor, the 24-byte
string in it of least hash, which equal prefixes share at the same offset; all
prefixes on one anchor occurrence form a factor of at most 76 bytes.

1. Documents are packed into blocks, a table bucketed by block, so that later
   steps bring their answers to the text and never move it.
2. Each block sends every distinct factor once, with its smallest document.
   Buckets order them by anchor and factor, and answer which were seen in an
   earlier document (all their prefixes go), and which first factors share
   their anchor with a different factor.
3. Only for the latter, the prefixes themselves are sent, once a block, and
   ordered likewise.
   An answer is a bit an entry, in the order in which the block sent them.
4. With each answer a bucket tells the block of the nearest smaller document, which
   sends the bytes asked of it, overlapping ones once, to the block that asks.
5. Blocks compare bytes. Where hashes agree and bytes do not, the strings in
   question, which are few, are looked up in all blocks as they are.
6. Blocks cut what is confirmed and hash what is left.

A passage that a third of all documents share is sent once a block, and its bytes
go from block to block. Hashes of prefixes have 64 bits, of factors 64 bits
besides those of their anchor.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import partitions, scratch_path, slices, store, utf8_buffers

LENGTH = 50
ANCHOR = 24
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 64 << 20  # of text for each bucket of hashes
_SLICE = 1 << 16
CODES = 256  # fewer make hashes collide
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FINAL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_ROW = "block bigint, ids binary, off binary, data binary"


def _byte_codes(n: int) -> np.ndarray:
    """Fixed 64-bit codes of the 256 bytes, ``n`` different ones."""
    codes = [int.from_bytes(hashlib.sha256(bytes([b % n])).digest()[:8], "little") | 1 for b in range(256)]
    return np.array(codes, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _FINAL
    x ^= x >> np.uint64(29)
    return x


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    down = np.full((2, n), 1, np.uint64)
    down[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
    np.multiply.accumulate(down, axis=1, out=down)
    return down[0], down[1]


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _STEP
    out += right
    out ^= out >> np.uint64(31)
    return out


def _hashes(data: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``ANCHOR`` and of the ``LENGTH`` bytes from each position on:
    polynomials in the base, as differences of running sums."""
    n = len(data)
    up, down = _powers(max(1 << (n - 1).bit_length(), _SLICE))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * up[:n], out=total[1:])

    def of(length: int) -> np.ndarray:
        out = total[length:] - total[: n - length + 1]
        out *= down[: n - length + 1]
        return _mix(out)

    return of(ANCHOR), of(LENGTH)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x, m = best(x[:-m], x[m:]), 2 * m
    return best(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def anchors(data: np.ndarray, off: np.ndarray, live: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
    """Anchor occurrences of a buffer: ``a``..``b`` the first and last start of the
    prefixes on it, ``row``, ``anchor`` and ``factor`` hashes; ``prefix`` has the
    hash of every start. Rows that are not ``live`` have none."""
    none = {k: np.zeros(0, np.int64) for k in ("a", "b", "row")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "factor", "prefix")}
    if len(data) < LENGTH:
        return none
    short, prefix = _hashes(data, codes)
    width = LENGTH - ANCHOR + 1
    least = _slide(short, width, np.minimum)  # one per prefix start
    size = np.diff(off)
    last = np.repeat(np.where(live, off[1:] - LENGTH, -1), size)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) <= last)
    if not len(starts):
        return none | {"prefix": prefix}
    want = least[starts]
    pad = np.zeros(width - 1, np.uint64)
    mark = _slide(np.concatenate((pad, least, pad)), width, np.maximum) == short
    picked = np.flatnonzero(mark)
    hashes = short[picked]
    j = (np.cumsum(mark) - mark)[starts]  # the first one at or after each start
    late = np.flatnonzero(hashes[j] != want)
    while len(late):
        j[late] += 1
        late = late[hashes[j[late]] != want[late]]
    row = np.repeat(np.arange(len(size)), size)[starts]
    at = picked[j]
    cut = np.flatnonzero(np.concatenate(([True], (j[1:] != j[:-1]) | (row[1:] != row[:-1]))))
    a, b = starts[cut], starts[np.append(cut[1:] - 1, len(starts) - 1)]
    at = at[cut]
    shape = ((at - a) * 64 + (b - a)).astype(np.uint64)
    factor = _mix(_pair(_pair(prefix[a], prefix[b]), shape))
    return {"a": a, "b": b, "row": row[cut], "anchor": short[at], "factor": factor, "prefix": prefix}


def _slice_anchors(data, off, live, codes):
    """``anchors`` of a block, slice by slice, in the block's positions; with each
    slice its prefix hashes and where they start. Only one slice is held at a time."""
    for lo, hi in slices(off, _SLICE):
        base = off[lo]
        found = anchors(data[base : off[hi]], off[lo : hi + 1] - base, live[lo:hi], codes)
        prefix = found.pop("prefix")
        found["a"], found["b"], found["row"] = found["a"] + base, found["b"] + base, found["row"] + lo
        yield found, prefix, base


def _rows(batch: pa.RecordBatch):
    """Rows of a batch as dicts; binary values are views, not copies."""
    for i in range(batch.num_rows):
        row = {}
        for name, col in zip(batch.schema.names, batch.columns, strict=True):
            cell = col[i]
            row[name] = (cell.as_buffer() if cell.is_valid else b"") if pa.types.is_binary(col.type) else cell.as_py()
        yield row


def _bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """Rows of a block each as a table bucketed by block."""
    spark = rows.sparkSession
    name = f"llm_{name}_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, "block").option("parquet.page.size.row.check.min", "1").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "blocks")).option("parquet.block.size", str(8 << 20)).saveAsTable(name)
    return spark.table(name)


def _packed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Blocks of about ``BLOCK_BYTES`` as rows of a table bucketed by block, its number of
    buckets, and that of the buckets of hashes, which follows the bytes of text."""

    def run(batches):
        block = TaskContext.get().partitionId() << 24  # 16 TB a partition
        for batch in batches:
            data, off = utf8_buffers(batch.column(1))
            for lo, hi in slices(off, BLOCK_BYTES):
                ids = batch.column(0).slice(lo, hi - lo)
                raw = (
                    ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                    np.append(off[lo:hi] - off[lo], off[hi] - off[lo]).astype(np.int64),
                    data[off[lo] : off[hi]],
                )
                nulls = np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
                row = [raw[0].tobytes() + nulls, raw[1].tobytes(), raw[2].tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64())] + [pa.array([x], pa.large_binary()).cast(pa.binary()) for x in row],
                    names=["block", "ids", "off", "data"],
                )
                block += 1

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, _ROW)
    buckets = 2 * partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return _bucketed(rows, "blocks", buckets), buckets, max(buckets, math.ceil(size / BUCKET_BYTES))


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, live flags, offsets and bytes of a block row."""
    off = np.frombuffer(row["off"], np.int64)
    n = len(off) - 1
    ids = np.frombuffer(row["ids"], np.int64, n)
    nulls = np.unpackbits(np.frombuffer(row["ids"], np.uint8, offset=8 * n), count=n).astype(bool)
    return ids, ~nulls, off, np.frombuffer(row["data"], np.uint8)


def _short_ids(ids: np.ndarray) -> bytes:
    """Ids as the first one and 16-bit steps, where the steps are that small."""
    step = np.diff(ids)
    if len(step) and (step.min() < -(1 << 15) or step.max() >= 1 << 15):
        return b"\x08" + ids.tobytes()
    return b"\x02" + ids[:1].tobytes() + step.astype(np.int16).tobytes()


def _long_ids(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x08":
        return np.frombuffer(raw, np.int64, offset=1)
    step = np.frombuffer(raw, np.int16, offset=9).astype(np.int64)
    return np.concatenate((np.frombuffer(raw, np.int64, 1, offset=1), step)).cumsum()


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the narrowest type that holds them, which comes first."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _dealing(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ordered by bucket, where each bucket begins, and 32 further bits of each key."""
    route = _mix(key + _STEP)  # anchors are minima: their own high bits are not even
    bucket = ((route >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    if n_buckets <= 1 << 16:
        bucket = bucket.astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=n_buckets)))), route.astype(np.uint32)


def _dealt(block: int, group: np.ndarray | None, value: np.ndarray, ids: np.ndarray, n_buckets: int):
    """Rows ``(bucket, block, groups, vals, ids)`` of one block: its entries in
    position order, dealt by their group, of which 32 further bits are sent.
    Without groups, entries are dealt by value."""
    order, edges, low = _dealing(value if group is None else group, n_buckets)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    at = [order[edges[b] : edges[b + 1]] for b in full]
    groups = [b"" if group is None else low[i].tobytes() for i in at]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array(groups, pa.binary())]
        + [pa.array([value[i].tobytes() for i in at], pa.binary()), pa.array([_short_ids(ids[i]) for i in at], pa.binary())],
        names=["bucket", "block", "groups", "vals", "ids"],
    )


def _firsts(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value the first entry of its smallest document, in position order; for each
    entry the number of its value's one there, and whether it is of a later document."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(values, kind="stable")
    new = np.concatenate(([True], values[order[1:]] != values[order[:-1]]))
    head, group, by = np.flatnonzero(new), np.cumsum(new) - 1, doc[order]
    above = by > np.minimum.reduceat(by, head)[group]
    first = order[np.minimum.reduceat(np.where(above, n, np.arange(n)), head)]
    rank = np.argsort(first)
    place, number, later = np.empty(len(rank), np.int64), np.empty(n, np.int64), np.empty(n, bool)
    place[rank] = np.arange(len(rank))
    number[order], later[order] = place[group], above
    return first[rank], number, later


_DEALT = "bucket bigint, block bigint, groups binary, vals binary, ids binary"


def previous_smaller(run: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it, within its run of equal prefixes, of a
    smaller document, or -1. Runs are contiguous and ordered by document, so a next
    smaller value never comes within a run."""
    head = np.concatenate(([True], run[1:] != run[:-1]))
    fresh = head.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.arange(len(run))
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(first > np.maximum.accumulate(np.where(head, at, 0)), first - 1, -1)


def _gathered(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The entries of a bucket: groups, values, ids, and their row in the frame."""
    size = [len(x) // 8 for x in frame["vals"]]
    cat = lambda c, t: np.frombuffer(b"".join(frame[c]), t)
    ids = np.concatenate([_long_ids(x) for x in frame["ids"]])
    return cat("groups", np.uint32), cat("vals", np.uint64), ids, np.repeat(np.arange(len(frame)), size)


_ANSWER = "bucket bigint, block bigint, gone binary, split binary, need binary, ask binary, who binary"


def _answers(frame: pd.DataFrame, order: np.ndarray, smaller: np.ndarray, split: np.ndarray, row: np.ndarray) -> pd.DataFrame:
    """Per block, a bit for each of its entries that is gone, and to be split further; and
    which entries' bytes it is to send (``need``): ``ask`` of them to each block in ``who``,
    given as steps. Entries stand in ``order``."""
    n = len(order)
    flags = np.zeros((2, n), bool)
    flags[0, order], flags[1, order] = smaller >= 0, split
    gone = np.flatnonzero(smaller >= 0)
    blocks = frame["block"].to_numpy(np.int64)
    start = np.searchsorted(row, np.arange(len(frame) + 1))
    source, asker = order[smaller[gone]], row[order[gone]]
    by = np.lexsort((source, asker, row[source]))
    source, asker = source[by], asker[by]
    edges = np.searchsorted(row[source], np.arange(len(frame) + 1))
    out = []
    for i in range(len(frame)):
        who, ask = np.unique(asker[edges[i] : edges[i + 1]], return_counts=True)
        need = source[edges[i] : edges[i + 1]] - start[i]
        bits = [np.packbits(f[start[i] : start[i + 1]]).tobytes() if f[start[i] : start[i + 1]].any() else b"" for f in flags]
        asks = [_small(need), _small(ask), _small(np.diff(blocks[who], prepend=0))] if len(need) else [b"", b"", b""]
        if bits[0] or bits[1] or asks[0]:
            out.append((int(frame["bucket"].iat[0]), int(blocks[i]), *bits, *asks))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _ANSWER.split(", ")])


def _told(found, order: np.ndarray, edges: np.ndarray, column: str) -> np.ndarray:
    """The bits of all buckets, for the entries that a block sent."""
    out = np.zeros(len(order), bool)
    for x in found or ():
        at = order[edges[x["bucket"]] : edges[x["bucket"] + 1]]
        if x[column]:
            out[at] = np.unpackbits(np.frombuffer(x[column], np.uint8), count=len(at)).astype(bool)
    return out


def _asked(asks, order: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose bytes are asked for, and the blocks that ask."""
    if not asks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = [order[edges[x["bucket"]] + _large(x["need"])] for x in asks]
    return np.concatenate(at), np.concatenate([np.repeat(np.cumsum(_large(x["who"])), _large(x["ask"])) for x in asks])


def _factors_of_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")
    anchor, factor, doc, row = _gathered(frame)
    order = np.lexsort((doc, factor, anchor))  # equal factors next to each other, by document
    anchor, factor, doc = anchor[order], factor[order], doc[order]
    new = np.concatenate(([True], (factor[1:] != factor[:-1]) | (anchor[1:] != anchor[:-1])))
    smaller = previous_smaller(np.cumsum(new), doc)
    group = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
    several = np.bincount(group, weights=new) > 1
    return _answers(frame, order, smaller, (smaller < 0) & several[group], row)


def _prefixes_of_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")
    _, prefix, doc, row = _gathered(frame)
    order = np.lexsort((doc, prefix))
    smaller = previous_smaller(prefix[order], doc[order])
    return _answers(frame, order, smaller, np.zeros(len(smaller), bool), row)


def _by_block(answers: DataFrame) -> DataFrame:
    """One row per block: the concatenated answers of all buckets."""
    asks = F.when(F.length("need") > 0, F.struct("bucket", "need", "ask", "who"))
    told = F.when(F.length("gone") + F.length("split") > 0, F.struct("bucket", "gone", "split"))
    return answers.groupBy("block").agg(F.collect_list(told).alias("found"), F.collect_list(asks).alias("asks"))


_PIECES = "asker bigint, docs binary, sizes binary, data binary"


def _pieces(at: np.ndarray, asker: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, data: np.ndarray) -> list[dict]:
    """The bytes of the entries ``at`` that are asked for, by asker: pieces that do not
    overlap, each with its document and size. Entries reach from ``begin`` to ``end``."""
    if not len(at):
        return []
    order = np.lexsort((begin[at], asker))
    at, asker = at[order], asker[order]
    a, e = begin[at], end[at]
    head = np.flatnonzero(np.concatenate(([True], (asker[1:] != asker[:-1]) | (a[1:] >= e[:-1]))))
    a, e, doc, asker = a[head], e[np.append(head[1:], len(e)) - 1], doc[at[head]], asker[head]
    edges = np.append(np.flatnonzero(np.concatenate(([True], asker[1:] != asker[:-1]))), len(asker))
    return [
        {
            "asker": int(asker[i]), "docs": doc[i:j].tobytes(), "sizes": (e[i:j] - a[i:j]).astype(np.int32).tobytes(),
            "data": b"".join(data[x:y].tobytes() for x, y in zip(a[i:j], e[i:j], strict=True)),
        }
        for i, j in zip(edges[:-1], edges[1:], strict=True)
    ]


def _all_prefixes(data: np.ndarray, off: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of the ``LENGTH`` bytes from each position on, where there are so many."""
    out = np.zeros(len(data), np.uint64)
    for lo, hi in slices(off, _SLICE):
        part = data[off[lo] : off[hi]]
        if len(part) >= LENGTH:
            out[off[lo] : off[hi] - LENGTH + 1] = _hashes(part, codes)[1]
    return out


def _confirmed(at, extra, want, doc, data, source, hashes, docs, ends) -> np.ndarray:
    """Which of the strings at ``at``, of ``extra`` bytes over ``LENGTH``, the bytes of
    ``source`` repeat, at the position with that hash in the smallest document. Its
    positions have ``hashes``, ``docs`` and the ends of their rows."""
    ok = np.zeros(len(at), bool)
    if not len(at) or len(source) < LENGTH:
        return ok
    low = np.uint64((1 << 20) - 1)
    wanted = np.zeros(1 << 20, bool)
    wanted[want & low] = True
    near = np.flatnonzero(wanted[hashes & low] & (np.arange(len(source)) + LENGTH <= ends))
    if not len(near):
        return ok
    near = near[np.lexsort((docs[near], hashes[near]))]
    here = near[np.minimum(np.searchsorted(hashes[near], want), len(near) - 1)]
    ok = (hashes[here] == want) & (docs[here] < doc) & (here + extra + LENGTH <= ends[here])
    window = np.lib.stride_tricks.sliding_window_view
    for step in (np.zeros_like(extra), extra):  # the extra bytes are fewer than LENGTH
        go = np.flatnonzero(ok)
        ok[go] = (window(data, LENGTH)[at[go] + step[go]] == window(source, LENGTH)[here[go] + step[go]]).all(axis=1)
    return ok


def _spread(raw) -> np.ndarray:
    """The positions of ranges."""
    ranges = np.frombuffer(raw, np.int32).reshape(-1, 2).astype(np.int64)
    size = ranges[:, 1] - ranges[:, 0]
    return np.repeat(ranges[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, and with
    ``keep_bytes`` the remaining bytes as ``kept``. Null text is empty; ids are
    whole numbers; rows of one id never remove from each other; a row with a null
    id neither removes nor loses anything."""
    blocks, n_tables, n_buckets = _packed(docs, id_col, text_col)

    def send_factors(batches):
        codes = _byte_codes(CODES)
        for batch in batches:
            for r in _rows(batch):
                ids, live, off, data = _opened(r)
                parts = [f for f, _, _ in _slice_anchors(data, off, live, codes)]
                if not parts:
                    continue
                anchor, factor, row = (np.concatenate([p[k] for p in parts]) for k in ("anchor", "factor", "row"))
                first = _firsts(factor, ids[row])[0]
                yield _dealt(r["block"], anchor[first], factor[first], ids[row[first]], n_buckets)

    sent = blocks.mapInArrow(send_factors, _DEALT).repartition(n_buckets, "bucket")
    answers = sent.groupBy("bucket").applyInPandas(_factors_of_bucket, _ANSWER)
    first = _by_block(answers)

    given = pa.list_(pa.struct([("asker", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]))

    def resolve(batches):
        """Applies the factors' answers: runs that go, and the prefixes still open."""
        codes = _byte_codes(CODES)
        for batch in batches:
            for r in _rows(batch):
                ids, live, off, data = _opened(r)
                kept, hashes = [], np.zeros(len(data), np.uint64)
                for p, prefix, base in _slice_anchors(data, off, live, codes):
                    hashes[base : base + len(prefix)] = prefix
                    kept.append(p)
                runs = open_at = np.zeros((0, 2), np.int32)
                give = []
                if kept:
                    a, b, row, anchor, factor = (np.concatenate([p[k] for p in kept]) for k in ("a", "b", "row", "anchor", "factor"))
                    first, number, later = _firsts(factor, ids[row])
                    order, edges, _ = _dealing(anchor[first], n_buckets)
                    gone = later | _told(r["found"], order, edges, "gone")[number]
                    split = ~gone & _told(r["found"], order, edges, "split")[number]
                    runs, open_at = (np.stack((a[x], b[x] + n), axis=1).astype(np.int32) for x, n in ((gone, LENGTH), (split, 1)))
                    at, asker = _asked(r["asks"], first[order], edges)
                    give = _pieces(at, asker, a, b + LENGTH, ids[row], data)
                open_hash = hashes[_spread(open_at.tobytes())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64())]
                    + [pa.array([memoryview(r[c]).tobytes()], pa.binary()) for c in ("ids", "off")]
                    + [pa.array([x], pa.binary()) for x in (runs.tobytes(), open_at.tobytes(), open_hash.tobytes())]
                    + [pa.array([give], given)],
                    names=["block", "ids", "off", "runs", "at", "hash", "give"],
                )

    joined = blocks.join(first, "block", "left")
    give = _PIECES.replace(" ", ":").replace(",:", ",")
    state_rows = joined.mapInArrow(resolve, f"block bigint, ids binary, off binary, runs binary, at binary, hash binary, give array<struct<{give}>>")
    state = _bucketed(state_rows, "runs", n_tables)

    def send_prefixes(batches):
        for batch in batches:
            for r in _rows(batch):
                at, prefix = _spread(r["at"]), np.frombuffer(r["hash"], np.uint64)
                if not len(at):
                    continue
                off = np.frombuffer(r["off"], np.int64)
                ids = np.frombuffer(r["ids"], np.int64, len(off) - 1)
                doc = ids[np.searchsorted(off, at, side="right") - 1]
                pick = _firsts(prefix, doc)[0]
                yield _dealt(r["block"], None, prefix[pick], doc[pick], n_buckets)

    prefixes = state.select("block", "ids", "off", "at", "hash").mapInArrow(send_prefixes, _DEALT).repartition(n_buckets, "bucket")
    second = _by_block(store(prefixes.groupBy("bucket").applyInPandas(_prefixes_of_bucket, _ANSWER), "prefixes"))

    def send_bytes(batches):
        for batch in batches:
            for r in _rows(batch):
                ids, _, off, data = _opened(r)
                at, prefix = _spread(r["at"]), np.frombuffer(r["hash"], np.uint64)
                doc = ids[np.searchsorted(off, at, side="right") - 1]
                pick = _firsts(prefix, doc)[0]
                order, edges, _ = _dealing(prefix[pick], n_buckets)
                give = _pieces(*_asked(r["asks"], pick[order], edges), at, at + LENGTH, doc, data)
                yield pa.RecordBatch.from_pylist(give, schema=pa.schema(given.value_type.fields))

    asked = second.where(F.size("asks") > 0).select("block", "asks")
    sent = blocks.join(state.select("block", "at", "hash"), "block").join(asked, "block").mapInArrow(send_bytes, _PIECES)
    pieces = state.select(F.explode("give").alias("g")).select("g.*").union(sent)
    pieces = pieces.groupBy(F.col("asker").alias("block")).agg(F.collect_list(F.struct("docs", "sizes", "data")).alias("pieces"))

    def compare(batches):
        """Starts of strings that go, as ranges, and those whose hashes agree with other bytes only."""
        codes = _byte_codes(CODES)
        for batch in batches:
            for r in _rows(batch):
                ids, live, off, data = _opened(r)
                at, prefix = _spread(r["at"] or b""), np.frombuffer(r["hash"] or b"", np.uint64)
                doc = ids[np.searchsorted(off, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
                pick, number, later = _firsts(prefix, doc)
                order, edges, _ = _dealing(prefix[pick], n_buckets)
                dup = at[later | _told(r["found"], order, edges, "gone")[number]]
                runs = np.frombuffer(r["runs"] or b"", np.int32).reshape(-1, 2).astype(np.int64)
                sure, left = np.zeros(len(data), bool), np.zeros(0, np.int64)
                if len(runs) or len(dup):
                    at, extra = np.concatenate((runs[:, 0], dup)), np.concatenate((runs[:, 1] - LENGTH - runs[:, 0], np.zeros(len(dup), np.int64)))
                    size, found = np.diff(off), r["pieces"] or []
                    # sources are the bytes sent here, and the rows of this block
                    sizes = [np.frombuffer(x["sizes"], np.int32).astype(np.int64) for x in found]
                    other_off = np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))))
                    other = np.frombuffer(b"".join(x["data"] for x in found), np.uint8)
                    other_ids = np.concatenate([np.frombuffer(x["docs"], np.int64) for x in found] or [np.zeros(0, np.int64)])
                    hashes, docs = _all_prefixes(data, off, codes), np.repeat(ids, size)
                    ends = np.repeat(np.where(live, off[1:], 0), size)
                    source = (
                        np.concatenate((data, other)), np.concatenate((hashes, _all_prefixes(other, other_off, codes))),
                        np.concatenate((docs, np.repeat(other_ids, np.diff(other_off)))),
                        np.concatenate((ends, np.repeat(other_off[1:], np.diff(other_off)) + len(data))),
                    )
                    ok = _confirmed(at, extra, hashes[at], docs[at], data, *source)
                    # where the smallest document goes on in another way, each string for itself
                    single = np.unique(_spread(np.stack((at[~ok], at[~ok] + extra[~ok] + 1), axis=1).astype(np.int32).tobytes()))
                    fine = _confirmed(single, np.zeros_like(single), hashes[single], docs[single], data, *source)
                    sure[_spread(np.stack((at[ok], at[ok] + extra[ok] + 1), axis=1).astype(np.int32).tobytes())] = True
                    sure[single[fine]] = True
                    left = single[~sure[single]]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], sure.view(np.int8), [0]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64())] + [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (edge, left)],
                    names=["block", "runs", "open"],
                )

    claims = blocks.join(state.select("block", "runs", "at", "hash"), "block", "left").join(second.select("block", "found"), "block", "left")
    checked = _bucketed(claims.join(pieces, "block", "left").mapInArrow(compare, "block bigint, runs binary, open binary"), "checked", n_tables)
    least = _least_documents(blocks, checked)
    schema = f"{id_col} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_bytes else "")

    def cut(batches):
        for batch in batches:
            for r in _rows(batch):
                ids, live, off, data = _opened(r)
                runs, open_at = np.frombuffer(r["runs"] or b"", np.int32).reshape(-1, 2), np.frombuffer(r["open"] or b"", np.int32)
                dup = [p for p in open_at if least[data[p : p + LENGTH].tobytes()] < ids[np.searchsorted(off, p, side="right") - 1]]
                dup = np.array(dup, np.int64)
                edge = np.bincount(np.concatenate((runs[:, 0], dup)), minlength=len(data) + 1) - np.bincount(
                    np.concatenate((runs[:, 1] + LENGTH - 1, dup + LENGTH)), minlength=len(data) + 1
                )
                removed = np.cumsum(edge[:-1]) > 0
                start = removed.copy()
                start[1:] &= ~removed[:-1]
                begins = off[:-1][off[:-1] < len(data)]
                start[begins] = removed[begins]
                total, spans = (np.concatenate(([0], np.cumsum(x))) for x in (removed, start))
                n_removed, n_spans = total[off[1:]] - total[off[:-1]], spans[off[1:]] - spans[off[:-1]]
                left = data[~removed].tobytes()
                bounds = off - total[off]
                kept = [left[bounds[i] : bounds[i + 1]] for i in range(len(ids))]
                columns = [pa.array(ids, mask=~live), pa.array(np.diff(off)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64))]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                columns += [pa.array(kept, pa.binary())] if keep_bytes else []
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    final = blocks.join(checked, "block", "left")
    return final.select("block", "ids", "off", "data", "runs", "open").mapInArrow(cut, schema)


def _least_documents(blocks: DataFrame, checked: DataFrame) -> dict[bytes, int]:
    """The smallest document of each string whose hash agreed with other bytes only: with
    64 bits a handful at most, so they are held on the driver and sent to every task."""
    left = checked.where(F.length("open") > 0).select("block", "open")
    if left.isEmpty():
        return {}

    def strings(batches):
        for batch in batches:
            for r in _rows(batch):
                data = _opened(r)[3]
                found = {data[p : p + LENGTH].tobytes() for p in np.frombuffer(r["open"], np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["s"])

    wanted = {bytes(r.s) for r in blocks.join(left, "block").mapInArrow(strings, "s binary").distinct().collect()}

    def search(batches):
        codes = _byte_codes(CODES)
        known = np.unique(_hashes(np.frombuffer(b"".join(wanted), np.uint8), codes)[1][::LENGTH])
        for batch in batches:
            for r in _rows(batch):
                ids, live, off, data = _opened(r)
                row, least = np.repeat(np.arange(len(ids)), np.diff(off)), {}
                whole = np.arange(len(data)) + LENGTH <= off[1:][row]
                for p in np.flatnonzero(whole & live[row] & np.isin(_all_prefixes(data, off, codes), known)):
                    x, doc = data[p : p + LENGTH].tobytes(), int(ids[row[p]])
                    if x in wanted:
                        least[x] = min(doc, least.get(x, doc))
                yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.int64())], names=["s", "doc"])

    found = blocks.mapInArrow(search, "s binary, doc bigint").groupBy("s").agg(F.min("doc").alias("doc"))
    return {bytes(r.s): r.doc for r in found.collect()}

"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints
differ in at most tau = 2 bits, some segment starts a chain of consecutive
segments whose cumulative differences stay within the proportional budgets
l * tau / 4 for every length l: 0, 1, 1, 2. Such a chain has an equal first
segment, and an equal second or third one, so equal pairs of segments bring
all candidates together; the chain test prunes them before the full Hamming
check.

Only distinct fingerprints are compared. A bucket of more than ``BUCKET``
members is not paired up: its members meet under the remaining 32 bits with
at most one bit flipped. Two of them differ in at most two bits exactly if
they share such a midpoint, and a midpoint has at most 33 members, so these
buckets cost 33 rows a member and lose no link.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import store
from faultlens.llm.components import connected_components

SEED = 42
MAX_BITS = 2
BUCKET = 32
_PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]


def fingerprint_bytes(raw: bytes, shingle: int = 3) -> bytes:
    """Big-endian fingerprint of one UTF-8 text; eight zero bytes without words."""
    words = raw.lower().split()  # on bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return bytes(8)
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    counts = np.zeros(64, np.int64)
    digests = map(xxhash.xxh64_digest, grams, repeat(SEED))
    for _ in range(0, n, 1 << 16):
        block = b"".join(d for d, _ in zip(digests, range(1 << 16), strict=False)) if n > 1 << 16 else b"".join(digests)
        counts += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp bigint)`` of every row; null or wordless text has fingerprint 0."""
    out_type = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            raws = b.column(1).cast(pa.binary()).to_pylist()
            fps = b"".join(fingerprint_bytes(r, shingle) if r else bytes(8) for r in raws)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64), pa.int64())], names=[id_col, "fp"]
            )

    schema = T.StructType([T.StructField(id_col, out_type), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _segment(col, i: int):
    return F.shiftrightunsigned(col, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _chain_ok(x):
    """True where the difference bits ``x`` hold a chain within the budgets."""
    d = [F.bit_count(_segment(x, i)) for i in range(4)]
    ok = F.lit(False)
    for i in range(4):
        a, b, c = d[i], d[(i + 1) % 4], d[(i + 2) % 4]
        ok = ok | ((a == 0) & (a + b <= 1) & (a + b + c <= 1) & (F.bit_count(x) <= MAX_BITS))
    return ok


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` at most two bits apart.
    Small buckets give every link; large ones a set of links with the same
    connected components."""
    keyed = store(
        distinct.select(
            "fp",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(k).alias("k"),
                            F.shiftleft(_segment(F.col("fp"), a), 16).bitwiseOR(_segment(F.col("fp"), b)).alias("key"),
                            # the other two segments, as one 32-bit number
                            F.shiftleft(_segment(F.col("fp"), c), 16).bitwiseOR(_segment(F.col("fp"), d)).alias("rest"),
                        )
                        for k, (a, b) in enumerate(_PAIRS)
                        for c, d in [tuple(sorted({0, 1, 2, 3} - {a, b}))]
                    ]
                )
            ).alias("s"),
        ).select("fp", "s.k", "s.key", "s.rest"),
        "segments",
    )
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["k", "key"])
    small = sized.where(F.col("n") <= BUCKET)
    a, b = small.select("k", "key", F.col("fp").alias("u")), small.select("k", "key", F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    pairs = a.join(b, ["k", "key"]).where((F.col("u") < F.col("v")) & _chain_ok(x)).where(F.bit_count(x) <= MAX_BITS)
    flips = F.concat(F.array(F.col("rest")), *[F.array(F.col("rest").bitwiseXOR(F.lit(1 << i))) for i in range(32)])
    mids = (
        sized.where(F.col("n") > BUCKET)
        .select("k", "key", "fp", F.explode(flips).alias("mid"))
        .groupBy("k", "key", "mid")
        .agg(F.collect_set("fp").alias("m"))  # 33 at most
        .where(F.size("m") > 1)
        .select(F.array_min("m").alias("u"), F.explode("m").alias("v"))
        .where("u <> v")
    )
    y = F.col("u").bitwiseXOR(F.col("v"))
    return pairs.select("u", "v").union(mids.where(F.bit_count(y) <= MAX_BITS).select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` of every row, repeats included. ``component_id`` is
    the smallest id reachable over links of at most two bits. Rows with a null id
    take the component of their fingerprint (null if none there has an id);
    empty texts link like any other. An empty table gives an empty one."""
    fps = store(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min(id_col).alias("rep"))
    labels = connected_components(near_pairs(reps.select("fp")))
    named = reps.join(labels, reps["fp"] == labels["node"], "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_fp = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, "fp", "component_id")

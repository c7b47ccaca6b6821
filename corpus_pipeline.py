"""Training-corpus pipeline over `documents`: a list of stages, each one operator.

Every stage takes the documents its predecessor kept and decides on each row by
its id and text, so repeated or null ids are decided apart. All but the last
return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import decontaminate, packing, secret_scan, simhash, toxicity
from faultlens.llm.common import scratch_path, store, table, with_key, without
from faultlens.llm.queries import encoder

REDACTED = "[REDACTED]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator, fitted on the labelled ones
    among them, predicts to be toxic."""
    scored = toxicity.toxicity(with_key(docs), table(spark, sf_dir, "labels"), key_col="key")
    return without(docs, scored.where("predicted = 1").select("key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the smallest id, null ids last;
    of repeated rows, one."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key.hash").alias("hash"))
    keyed = with_key(docs).select(order.alias("key"), "text")
    found = store(simhash.near_duplicates(keyed, id_col="key"), "near")
    stay = found.groupBy("component_id").agg(F.sum((F.col("key") == F.col("component_id")).cast("bigint")).alias("n"))
    stay = stay.select(F.col("component_id.id").alias("stay_id"), F.col("component_id.hash").alias("stay_hash"), "n")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]) & (own == stay["stay_hash"]))
    once = joined.where("n = 1").select(*[docs[c] for c in docs.columns])
    if stay.where("n > 1").isEmpty():
        return once
    again = joined.where("n > 1").dropDuplicates(["stay_id", "stay_hash"]).select(*[docs[c] for c in docs.columns])
    return once.union(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the contamination rule marks."""
    index = decontaminate.build_index(with_key(docs), id_col="key")
    hits = decontaminate.phrase_hits(index, table(spark, sf_dir, "benchmark"), id_col="key")
    return without(docs, hits.where(decontaminate.contaminated()).select("key"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every stretch of text that secret spans cover by ``REDACTED``, and
    `n_chars` by the new length where the text changed."""
    found, _ = secret_scan.scan(docs)
    hits = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("blob").alias("hit_blob"), "spans")
    hits = hits.dropDuplicates(["hit_id", "hit_blob"]).withColumnRenamed("spans", "hit_spans")
    joined = docs.join(
        hits, docs["doc_id"].eqNullSafe(hits["hit_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == hits["hit_blob"]), "left"
    )
    text = docs["text"]
    cut = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        # an overlapping span only moves the end of the stretch that is gone
        apart = F.concat(acc["out"], cut(acc["at"], s["start"] - acc["at"]), F.lit(REDACTED))
        new = (s["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, apart).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate("hit_spans", start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(text) - acc["at"])))
    clean = F.when(F.col("hit_spans").isNull(), text).otherwise(rest)
    shown = {"text": clean, "n_chars": F.when(F.col("hit_spans").isNull(), docs["n_chars"]).otherwise(F.length(clean).cast("bigint"))} if "n_chars" in docs.columns else {"text": clean}
    return joined.select(*[shown[c].alias(c) if c in shown else docs[c] for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the pieces of all documents into sequences."""
    return packing.pack(packing.pieces(docs, encoder()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

# The toxicity model is no SQL; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to `documents`; each result is written as Parquet
    and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

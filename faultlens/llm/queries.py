"""The registered queries of the operators: ``(spark, sf_dir) -> DataFrame``.

Each applies its operator with production parameters to the whole table and
derives the contract's columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import (
    decontaminate, hard_negatives, html_text, langid, mixing, packing, repeats, secret_scan, simhash, spelling, token_counts, topk, toxicity,
)
from faultlens.llm.common import table
from faultlens.llm.tokenizer import byte_bpe, counting

TOKENIZER = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


def encoder(name: str = TOKENIZER) -> Callable:
    """Ids of the public 50k byte-level vocabulary (ranks form of byte_bpe_50k.json)."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path(name), public_tokenizers.PATTERN, SPECIAL)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, trees)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[secret_scan.count_of("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(secret_scan.base("spans")), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    found = decontaminate.phrase_hits(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, then of the document after two edits drawn from its
    id: twelve characters make way for its source's name, and a clause goes in."""
    docs, count = table(spark, sf_dir, "documents"), counting(encoder())
    state = token_counts.trees(docs.select(F.struct("doc_id", "source").alias("row"), "text"), count, id_col="row")
    size = F.length("text")
    at = lambda salt: F.pmod(F.xxhash64("row.doc_id", F.lit(salt)), size + 1).cast("bigint")
    edits = F.array(
        F.struct(at(1).alias("at"), F.lit(12).cast("bigint").alias("cut"), F.coalesce("row.source", F.lit("")).alias("put")),
        F.struct(at(2).alias("at"), F.lit(0).cast("bigint").alias("cut"), F.lit(", as edited later,").alias("put")),
    )
    done = token_counts.apply_edits(state.withColumn("edits", edits), count, id_col="row")
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("before").alias("n_tokens"),
        F.col("tokens")[1].alias("n_tokens_edited"),
        F.col("chars")[1].alias("n_chars_edited"),
        F.col("encoded").alias("n_chars_encoded"),
        F.sha2("text", 256).alias("edited_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), encoder()))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_toxicity, op2_repeats, op3_langid, op4_topk, op5_secrets,
        op6_decontaminate, op7_html, op8_token_counts, op9_simhash, op10_packing,
        op11_hard_negatives, op12_mixing, op13_spelling,
    )
}

#: DuckDB SQL for the same rows, where it can express the operator on whole tables.
ORACLES: dict[str, str] = {
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_secrets": secret_scan.oracle_sql(),
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, count(*) AS n FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY ALL),
             e AS (SELECT vec_id, label, q, unnest(range(n)) AS copy FROM v),
             a AS (SELECT vec_id, label, q, row_number() OVER (ORDER BY vec_id, label, q) AS a FROM v WHERE vec_id % 50 = 0),
             s AS (SELECT a.a, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same,
                          list_sum(list_transform(list_zip(a.q, e.q), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM a JOIN e ON a.vec_id <> e.vec_id),
             p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
             r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                          row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
                   FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
                   WHERE p.nth <= 5)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
    """,
    "op13_spelling": spelling.oracle_sql(),
}

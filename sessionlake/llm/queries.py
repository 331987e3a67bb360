"""One query per operator over its whole table, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import (
    ann, chat, langid, masked_lm, merkle, mixing, neardup, packing, pii, quality, simhash, spelling, tokencount,
)
from sessionlake.llm.columns import table, vocabulary
from sessionlake.llm.oracle import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, said)
    done = chat.formatted(turns.unionByName(own))
    turn = chat.read_back(F.col("formatted"))
    read = done.withColumns({"t": turn, "learned": chat.learned_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.trained(docs.where(fold != 1).select(F.col("doc_id").alias("key"), "lang", "text"))
    found = langid.identified(docs, model)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])
    spans = F.col("pii_spans")
    return found.select(
        "doc_id", *[pii.counted(spans, k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"))


@query
def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.scored(docs, masked_lm.trained(docs))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


@query
def op12_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf = merkle.leaf(*before, F.col("n_chars"), F.col("text"))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    carry = {"doc_id": F.col("doc_id"),
             "tampered": F.when(tampered, merkle.leaf(*before, F.col("n_chars") + 1, F.col("text")))}
    found = merkle.proofs(merkle.manifest(docs, leaf, F.col("lang"), F.col("doc_id"), carry), carry)
    told = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return told.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES["pipeline"] = corpus_pipeline.run

"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm import mixing, neardup, packing, pii, quality
from sessionlake.llm.columns import table, vocabulary, whole_row
from sessionlake.workspace import written


def _row(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns beside the whole input row, whose own columns so clash with none."""
    return docs.select(whole_row(docs).alias("row"), *columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns. Null and empty texts go; rows
    that repeat are judged alike; an empty table stays empty."""
    return quality.judged(_row(docs, F.col("text"))).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; of rows that
    repeat an id and a text, one, of the smallest source. Rows without an id stay, as do
    null and empty texts, once for each id. All columns are kept."""
    kept = neardup.near_duplicates(docs, width=5, percent=80).where("kept and doc_id is not null").select(
        "doc_id", F.col("text_hash").alias("hash")).distinct()
    rows = _row(docs, F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("hash")).join(kept, ["doc_id", "hash"])
    first = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("source"))
    return rows.withColumn("n", first).where("n = 1").select("row.*").unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars is counted again where a text
    changes. Null and empty texts and all other columns stay as they are; rows that repeat
    are changed alike."""
    found = pii.personal_data(_row(docs, F.col("text")), carry=["row"], keep=False)
    text, changed = F.col("row.text"), F.size("pii_spans") > 0
    found = found.withColumn("told", F.when(
        changed, pii.redacted(F.coalesce(text, F.lit("")), F.col("pii_spans"))).otherwise(text))
    new = {"text": F.col("told"),
           "n_chars": F.when(changed, F.length("told").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns. Null is a source of its own;
    null and empty texts have no words and are taken only as far as the sum of their source passes a
    whole number; of rows that repeat, the first carries the copies of all."""
    key = F.concat_ws(":", F.xxhash64("text", "source").cast("string"), F.col("doc_id").cast("string"))
    keyed = _row(docs, F.col("text"), F.col("source"), key.alias("key"))
    copies = mixing.mixed(keyed, id_col="key").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("source"))
    rows = keyed.select("row", "source", "key").join(copies.where("copies > 0"), "key").withColumn("n", first).where("n = 1")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens. A null or empty text
    is one piece of one token; rows that repeat are packed once each; other columns are not looked at."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The sketches, the trained classifier and the tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Corpus cleaning in five stages, each one text operator over all that its predecessor kept.

Toxic documents go; lines that repeat go from texts; one document of each near-duplicate group stays;
documents that hold a benchmark item go; what is left is cut into SentencePiece ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargosift.llm import decontam, lines, pieces, simhash, toxicity
from cargosift.llm.common import fresh, scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the nearest labelled examples do not call toxic; null, empty and wordless texts stay, repeated rows fare alike."""
    index = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("text", F.struct(*docs.columns).alias("_doc")), index)  # columns of any name come back as they were
    return scored.where(F.col("predicted") == 0).select("_doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that occurred before, here or in another document; every document stays, null texts too, n_chars follows the text."""
    out = lines.without_repeats(docs, short_copies=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each group that names it, of repeated rows one; rows without id stay. Five-word runs, similarity 0.8.

    SimHash fingerprints linked by op9's trie bring texts together, MinHash bands those whose fingerprints differ in more bits; pairs are verified.
    Null texts and texts without a word are in no group.
    """
    row, key = F.xxhash64("doc_id", "text"), fresh(docs, "_row")
    named = simhash.similar(docs.select("doc_id", "text", row.alias(key)), keep=(key,)).where("doc_id = component_id").select(key).distinct()
    own = docs.where(F.col("doc_id").isNotNull()).withColumn(key, row).join(named, key, "left_semi").dropDuplicates([key])
    return own.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; rows are told apart by id and text, so those without id are searched too. Null texts hold none."""
    row, key = F.xxhash64("doc_id", "text"), fresh(docs, "_row")
    found = decontam.contaminated(docs.select(row.alias("_row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return docs.withColumn(key, row).join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_pieces, piece_score and nbest_scores; null texts count as empty and have no pieces."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

# Toxicity, SimHash and SentencePiece have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

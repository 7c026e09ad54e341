"""A training-data pipeline over documents: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; run() writes each
stage's rows as Parquet in the shared folder and reads them again for the next one. All stages but the last
return the columns of documents. Repeated rows that are one document (same id and text) are kept once by
the near-duplicate stage; null and empty texts are judged like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.common import materialize, release
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.minhash import near_duplicates, text_digest
from tessera.llm.pii import pseudonymize, session_key
from tessera.llm.quality import keep_good
from tessera.session import ship_package

#: SQL can't express a fitted classifier, sketches or merges: the stages are tested against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Rows are removed one by one: another text with the same id is judged by its own group.
    """
    ship_package(spark)
    groups = near_duplicates(docs, digests=True)
    gone = materialize(groups.filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_digest").alias("_gone_text")).distinct())
    # texts meet what goes by their rows' keys at every size: what goes grows with the documents, so it isn't broadcast
    kept = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (text_digest() == F.col("_gone_text")), "left_anti")
    again = groups.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_again_id"))
    again = materialize(again)
    release(groups)
    if again.isEmpty():
        return kept
    # rows that share an id: of those with equal texts one stays
    same = F.col("doc_id").eqNullSafe(F.col("_again_id"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ship_package(spark)
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text."""
    out = pseudonymize(docs, session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    ship_package(spark)
    out = bpe_encode(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return docs

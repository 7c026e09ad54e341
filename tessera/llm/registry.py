"""The ten training-data operators as queries over the whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.classlm import lm_scores
from tessera.llm.common import held_out
from tessera.llm.decontaminate import contamination
from tessera.llm.fingerprint import fingerprint_report
from tessera.llm.licenses import license_scan
from tessera.llm.minhash import near_duplicates
from tessera.llm.pii import pii_report, session_key
from tessera.llm.quality import quality_scores
from tessera.llm.toxicity import toxicity_scores
from tessera.llm.urls import labelled_by_hosts, url_verdicts
from tessera.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _shipped(f):
    """The query with this package given to the Python workers first."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's exact fingerprint, and its edited text's."""
    return fingerprint_report(_documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; the labels that the trees learn from come from listed words of host names, of pages that aren't held out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, labelled_by_hosts(pages.filter(~held_out("page_id", 5)))).withColumn("held_out", held_out("page_id", 5))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which the document has a copy within the error budget."""
    return contamination(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under the class model, and under word frequencies alone."""
    return lm_scores(spark, _documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    out = bpe_encode(spark, _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return quality_scores(spark, _documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence labels."""
    return license_scan(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return toxicity_scores(spark, _documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a similarity of 85 % or more."""
    return near_duplicates(_documents(spark, sf_dir), shingle_words=3, percent=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of its personal data."""
    return pii_report(_documents(spark, sf_dir), session_key(spark))


#: All pairs that share a shingle, and all that can be reached: for small tables.
ORACLE_SQL["op9_near_duplicates"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS shingle
    FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS i FROM w WHERE len(t) > 0)
), c AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), r(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT g.v, r.root FROM r JOIN (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e) g ON g.u = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id"""

for _f in (op1_fingerprints, op2_url_filter, op3_decontaminate, op4_class_lm, op5_bpe, op6_quality, op7_licenses, op8_toxicity, op9_near_duplicates, op10_pii):
    QUERIES[_f.__name__] = _shipped(_f)

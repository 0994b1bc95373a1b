"""Registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentwise.session import checkpoint_dir

from . import (audit, codes, decontaminate, exact_dedup, html_text, language, ngram_join, pieces, quality, rollups, rules,
               secret_scan, toxicity)
from .common import ids_join, staged
from .sql import ORACLES  # noqa: F401  (read by the registry)

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern published with the rank file
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("hot")


def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark, sf_dir):
    # a repository is a source's part in one language, its owner the source
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs.withColumn("repository", F.concat_ws("/", "source", "lang")), repo="repository")


def op5_html_extraction(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark, sf_dir, model=PIECES):
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), model, decoded=True)
    return coded.select("doc_id", "n_ids", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark, sf_dir, ranks=RANKS, pattern=PATTERN):
    """The ledger after four commits over all documents, one of them delivered twice.

    1: every document is inserted with its tokens; 2: exact copies that op2 drops
    are deleted; 3: kept documents with license lines are revised to the count of
    their text without them; 2 is delivered again.
    """
    docs = table(spark, sf_dir, "documents")
    ledger = rollups.TokenLedger(spark, f"{checkpoint_dir(spark).rstrip('/')}/token-ledger-{uuid.uuid4().hex}")
    count = lambda rows, event: rollups.events_of(rows, event, ranks, pattern, "byte_bpe_50k")
    ledger.commit(1, count(docs, "insert"))
    copies = exact_dedup.exact_dedup(docs).where("NOT kept").select(
        F.lit("delete").alias("event"), "doc_id", F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"), F.lit("byte_bpe_50k").alias("version"), F.lit(0).cast("long").alias("tokens"))
    copies = staged(copies, "token-copies")
    ledger.commit(2, copies)
    licensed = docs.where(F.contains("text", F.lit("Licensed under"))).withColumn(
        "text", F.regexp_replace("text", r"\n?Licensed under [^\n]*", ""))
    ledger.commit(3, count(ids_join(licensed, copies.select("doc_id").distinct(), "doc_id", "left_anti"), "revise"))
    ledger.commit(2, copies)
    return ledger.totals()


def op11_quality_rules(spark, sf_dir):
    return rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark, sf_dir):
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark, sf_dir):
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))

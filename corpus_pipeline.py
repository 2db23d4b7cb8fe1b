"""A corpus from raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Cases: a null text is scored, fingerprinted and scanned as an empty one, has no words for the mix to
take and so ends there; a null doc_id is a document, and rows that repeat a doc_id are told apart by
their fingerprints; rows that repeat a whole document are near-duplicates of each other, and where the mix gets
them each is a document; a null source is a source of its own, the last; empty tables give empty
results; other columns, whatever their names, stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import byte_bpe, common, mixing, near_copies, quality_model, secrets, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant rejects go."""
    common.bound_batches(spark)
    return quality_model.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Linked are fingerprints within op9's 2 bits, and texts whose five-word shingles have a
    Jaccard similarity of 0.8 or more.
    """
    common.bound_batches(spark)
    marked = near_copies.marks(docs)
    return simhash.representatives(docs, hashed=marked.select("doc_id", "fp"), more=near_copies.links(docs, marked))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced in the text; no document goes."""
    common.bound_batches(spark)
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights: a row for each copy, in order of training."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the decoded text."""
    common.bound_batches(spark)
    return byte_bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: SQL can't express the fitted models, XXH64 or merge ranks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

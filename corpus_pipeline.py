"""From documents to packed sequences, in five stages that each call one operator.

Every stage works on all that the one before kept.  The first drops documents, the
second leaves one of each near-duplicate group, the third masks secrets in texts, the
fourth takes documents up to three times by their sources' targets, and the last
returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, secrets, toxicity
from tessera.llm.common import forget, staged, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the model learns from the labels of ``sf_dir``."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), *COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked at a similarity of 0.8 on 5-word shingles."""
    return jaccard.one_of_each_group(docs.select(*COLUMNS), width=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials masked."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, a row for each pass."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A fitted model, drawn blocks and a tokenizer stand between documents and rows, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and reread by the next.

    A null text counts as empty in every stage, a null doc_id, source or other column
    is a value like others, and rows that repeat are rows each until the second stage
    leaves one of them.  No documents give no rows.  What a stage wrote for itself is
    deleted when its result has been written.
    """
    docs = table(spark, sf_dir, "documents")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        forget(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, fingerprints, jaccard, mixing, neardup, packing, secrets, surrogates, tokencounts, toxicity
from tessera.llm.oracles import SQL

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokencounts.op1_token_counts,
        toxicity.op5_toxicity,
        jaccard.op2_ngram_jaccard,
        secrets.op3_secret_scans,
        chat.op4_chat_formatting,
        mixing.op6_mixing,
        fingerprints.op7_fingerprints,
        surrogates.op8_pii_surrogates,
        packing.op9_best_fit_packing,
        neardup.op10_embedding_neardup,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

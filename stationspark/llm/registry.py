"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, jaccard, linededup, packing, pii, repair, resample, secrets, tokens, toxicity, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        pii.op1_personal_data,
        linededup.op2_line_dedup,
        vectors.op3_exact_top_k,
        secrets.op4_secret_scan,
        tokens.op5_bpe_round_trip,
        toxicity.op6_toxicity,
        chat.op7_chat_format,
        jaccard.op8_ngram_jaccard_join,
        vectors.op9_embedding_near_duplicates,
        packing.op10_best_fit_packing,
        resample.op11_importance_resampling,
        warc.op12_warc_round_trip,
        repair.op13_conversation_repair,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.OP2_SQL, "op11_importance_resampling": resample.OP11_SQL, "op12_warc_round_trip": warc.OP12_SQL, "op13_conversation_repair": repair.OP13_SQL}

"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import alignment, decontamination, fingerprints, jaccard, language, minhash, mixing, privacy, quality, ranking, secrets, tokens, toxicity

Plan = Callable[[SparkSession, str], DataFrame]


def runnable() -> dict[str, Plan]:
    return {
        f.__name__: f
        for f in (
            decontamination.op1_decontaminate,
            secrets.op2_secrets,
            quality.op3_quality,
            jaccard.op4_near_duplicates,
            language.op5_language,
            toxicity.op6_toxicity,
            tokens.op7_token_counts,
            privacy.op8_privacy,
            fingerprints.op9_fingerprints,
            mixing.op10_mix,
            minhash.op11_minhash,
            ranking.op12_ranked_search,
            alignment.op13_alignment,
        )
    }


def sql_texts() -> dict[str, str]:
    return {"op10_mix": mixing.SQL, "op12_ranked_search": ranking.SQL}

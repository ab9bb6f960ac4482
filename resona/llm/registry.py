"""Queries of the operators by name, and the DuckDB SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from resona.llm import (
    bpe, codes, conversations, decontaminate, extract, fingerprints, language, passages, quality, simhash, tokens, toxicity, urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": bpe.op1,
        "op2_fingerprints": fingerprints.op2,
        "op3_language": language.op3,
        "op4_urls": urls.op4,
        "op5_quality": quality.op5,
        "op6_decontaminate": decontaminate.op6,
        "op7_simhash": simhash.op7,
        "op8_passages": passages.op8,
        "op9_toxicity": toxicity.op9,
        "op10_extract": extract.op10,
        "op11_conversations": conversations.op11,
        "op12_token_counts": tokens.op12,
        "op13_vector_codes": codes.op13,
    }


def statements() -> dict[str, str]:
    return {"op4_urls": urls.SQL, "op13_vector_codes": codes.SQL}

"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers

from unitflow.llm import bpe, centroids, conversations, fingerprints, language_id, line_dedup, near_dedup, packing, pii, quality, records, substring_dedup, token_counts
from unitflow.llm.common import read_documents
from unitflow.llm.sql import ORACLES

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def queries() -> dict:
    over = lambda f: lambda spark, sf_dir: f(read_documents(spark, sf_dir))
    coded = lambda f, name: lambda spark, sf_dir: f(read_documents(spark, sf_dir), public_tokenizers.path(name))
    return {
        "op1_line_dedup": over(line_dedup.op1_line_dedup),
        "op2_language_id": over(language_id.op2_language_id),
        "op3_fingerprints": over(fingerprints.op3_fingerprints),
        "op4_packing": coded(packing.op4_packing, WORD_VOCABULARY),
        "op5_near_dedup": over(near_dedup.op5_near_dedup),
        "op6_bpe": coded(bpe.op6_bpe, BYTE_VOCABULARY),
        "op7_pii": over(pii.op7_pii),
        "op8_quality": over(quality.op8_quality),
        "op9_token_output": coded(records.op9_token_output, BYTE_VOCABULARY),
        "op10_substring_dedup": over(substring_dedup.op10_substring_dedup),
        "op11_centroids": lambda spark, sf_dir: centroids.op11_centroids(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op12_conversations": lambda spark, sf_dir: conversations.op12_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op13_token_counts": coded(token_counts.op13_token_counts, WORD_VOCABULARY),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The subpackage's queries and their SQL."""

from __future__ import annotations

from ridgeplan.llm import binary_output, decontaminate, jaccard, packing, quality, secrets, substring_dedup, token_counts, toxicity, vector_search

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality": quality.op2_quality,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_top_k": vector_search.op4_top_k,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_token_files": binary_output.op8_token_files,
    "op9_secrets": secrets.op9_secrets,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLE_SQL = {**substring_dedup.ORACLE_SQL, **jaccard.ORACLE_SQL, **vector_search.ORACLE_SQL, **decontaminate.ORACLE_SQL}

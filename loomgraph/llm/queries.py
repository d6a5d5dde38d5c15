"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import ann, bpe, decontaminate, html_text, line_dedup, secrets, sharding, simhash_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_nearest_neighbours": ann.query,
        "op2_benchmark_decontamination": decontaminate.query,
        "op3_sharding": sharding.query,
        "op4_bpe": bpe.query,
        "op5_token_counts": token_counts.query,
        "op6_line_dedup": line_dedup.query,
        "op7_toxicity": toxicity.query,
        "op8_secrets": secrets.query,
        "op9_html_extraction": html_text.query,
        "op10_simhash_near_dedup": simhash_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_nearest_neighbours": ann.ORACLE, "op3_sharding": sharding.ORACLE, "op6_line_dedup": line_dedup.ORACLE}

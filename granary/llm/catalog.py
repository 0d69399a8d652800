"""The registered queries of the corpus operators."""

from __future__ import annotations

from granary.llm import ann, exact_topk, line_dedup, mixing, near_duplicates, packing, phrases, pii, quality, simhash, token_counts, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_pii": pii.op3_pii,
        "op4_near_duplicates": near_duplicates.op4_near_duplicates,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_ann": ann.op6_ann,
        "op7_exact_topk": exact_topk.op7_exact_topk,
        "op8_quality": quality.op8_quality,
        "op9_packing": packing.op9_packing,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_phrases": phrases.op12_phrases,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": near_duplicates.OP4_SQL, "op7_exact_topk": exact_topk.OP7_SQL, "op10_line_dedup": line_dedup.OP10_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_phrases": phrases.OP12_SQL}

"""Queries of this subpackage and their SQL, where SQL can express them on whole tables."""

from clausegrid.llm import bpe, chat_format, decontaminate, exact_dedup, hmm_lm, html_extract, langid, simhash, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_lm_score": hmm_lm.op3_lm_score,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_language_id": langid.op6_language_id,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_bpe": bpe.op9_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {"op1_decontaminate": decontaminate.OP1_SQL, "op5_chat_format": chat_format.OP5_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}

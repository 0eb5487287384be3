"""Queries of the text operators, and the SQL of those that SQL can express."""

from . import conversation_repair, exact_dedup, importance, language_id, line_dedup, lm_scoring, mixing, packing, simhash, token_files, topk_search, toxicity, whitening

QUERIES = {
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_whitening": whitening.op11_whitening,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_id": language_id.op4_language_id,
    "op5_importance": importance.op5_importance,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_mixing": mixing.op9_mixing,
}
SQL = {
    "op12_line_dedup": line_dedup.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
    "op6_topk_search": topk_search.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_mixing": mixing.SQL,
}

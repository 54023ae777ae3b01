"""The training-data queries and their SQL."""

from __future__ import annotations

from . import class_lm, content_store, exact_dedup, line_crf, mixing, near_dedup, packing, quality_knn, spelling, substring_dedup, topk_search, toxicity, turn_repair

QUERIES = {
    "op1_content_store": content_store.op1_content_store,
    "op2_chosen_path": near_dedup.op2_chosen_path,
    "op3_block_naming": exact_dedup.op3_block_naming,
    "op4_line_crf": line_crf.op4_line_crf,
    "op5_class_lm": class_lm.op5_class_lm,
    "op6_knn_quality": quality_knn.op6_knn_quality,
    "op7_packing": packing.op7_packing,
    "op8_lz_substrings": substring_dedup.op8_lz_substrings,
    "op9_nnpu_toxicity": toxicity.op9_nnpu_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_spelling": spelling.op12_spelling,
    "op13_topk": topk_search.op13_topk,
}

ORACLE_SQL = {"op3_block_naming": exact_dedup.OP3_SQL, "op13_topk": topk_search.OP13_SQL}

"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from packetloom.llm import centroids, chat, extraction, mixing, nbsvm, packing, quality, rans, resampling, runs, search, simhash, substrings

QUERIES = {
    "op1_bm25_topk": search.op1_bm25_topk,
    "op2_mincut_extraction": extraction.op2_mincut_extraction,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality_cascade": quality.op4_quality_cascade,
    "op5_rans_file": rans.op5_rans_file,
    "op6_relative_lz": substrings.op6_relative_lz,
    "op7_run_length_index": runs.op7_run_length_index,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_kk_packing": packing.op9_kk_packing,
    "op10_prefix_tree_chat": chat.op10_prefix_tree_chat,
    "op11_line_resampling": resampling.op11_line_resampling,
    "op12_sharded_lloyd": centroids.op12_sharded_lloyd,
    "op13_nbsvm_quality": nbsvm.op13_nbsvm_quality,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_bm25_topk": search.OP1_SQL,
    "op4_quality_cascade": quality.OP4_SQL,
    "op8_pareto_mix": mixing.OP8_SQL,
    "op11_line_resampling": resampling.OP11_SQL,
    "op12_sharded_lloyd": centroids.OP12_SQL,
}

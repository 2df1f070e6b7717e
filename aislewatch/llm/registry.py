"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from aislewatch.llm import byte_bpe, decontamination, embedding_dedup, jaccard_join, language, lexical_search, licenses, mixing, quality, sharding, token_files, toxicity, vector_codes

QUERIES = {
    "op1_pca_tiles": embedding_dedup.op1_pca_tiles,
    "op2_byte_gru": language.op2_byte_gru,
    "op3_token_files": token_files.op3_token_files,
    "op4_bradley_terry": quality.op4_bradley_terry,
    "op5_subsequence_svm": toxicity.op5_subsequence_svm,
    "op6_block_mix": mixing.op6_block_mix,
    "op7_template_markup": licenses.op7_template_markup,
    "op8_wu_manber": decontamination.op8_wu_manber,
    "op9_balanced_label_propagation": sharding.op9_balanced_label_propagation,
    "op10_token_group_matrix": jaccard_join.op10_token_group_matrix,
    "op11_segment_tree": byte_bpe.op11_segment_tree,
    "op12_grid_cells": vector_codes.op12_grid_cells,
    "op13_block_max_maxscore": lexical_search.op13_block_max_maxscore,
}

ORACLE_SQL = {"op12_grid_cells": vector_codes.SQL, "op13_block_max_maxscore": lexical_search.SQL, "op7_template_markup": licenses.SQL, "op1_pca_tiles": embedding_dedup.SQL, "op8_wu_manber": decontamination.SQL, "op10_token_group_matrix": jaccard_join.SQL}

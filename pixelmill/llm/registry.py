"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

from .centroid_clusters import OP11_SQL, op11_centroid_clusters
from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import OP8_SQL, op8_decontaminate
from .embedding_dedup import OP13_SQL, op13_embedding_dedup
from .hmm_lm import op6_lm_score
from .language_id import op5_language_id
from .line_dedup import op9_line_dedup
from .packing import op2_packing
from .simhash import op3_simhash
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import op7_suffix_dedup
from .topk_search import OP4_SQL, op4_topk_search
from .whitening import op12_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_topk_search": op4_topk_search,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_whitening": op12_whitening,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op4_topk_search": OP4_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op13_embedding_dedup": OP13_SQL,
}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import knn_join, near_dup, quality_rules
from .byte_bpe import op7_byte_level_bpe
from .html_text import op4_html_extraction
from .knn_join import op11_exact_top_k
from .near_dup import op6_minhash_near_dedup
from .packing import op3_best_fit_packing
from .pitman_yor import op10_lm_scoring
from .quality_rules import op1_quality_rules
from .secret_scan import op8_secret_scans
from .simhash import op9_document_fingerprints
from .token_counts import op2_token_counts
from .url_filter import op5_url_filters
from .whitening import op12_embedding_whitening

QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_token_counts": op2_token_counts, "op3_best_fit_packing": op3_best_fit_packing, "op4_html_extraction": op4_html_extraction, "op5_url_filters": op5_url_filters, "op6_minhash_near_dedup": op6_minhash_near_dedup, "op7_byte_level_bpe": op7_byte_level_bpe, "op8_secret_scans": op8_secret_scans, "op9_document_fingerprints": op9_document_fingerprints, "op10_lm_scoring": op10_lm_scoring, "op11_exact_top_k": op11_exact_top_k, "op12_embedding_whitening": op12_embedding_whitening}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality_rules.SQL, "op6_minhash_near_dedup": near_dup.SQL, "op11_exact_top_k": knn_join.SQL}

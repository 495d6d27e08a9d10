"""The numbered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .filter_audit import OP11_SQL, op11_filter_audit
from .katz import op8_katz_scores
from .language import op4_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op9_pivotal_mixing
from .near_duplicates import op7_jaccard_join
from .packing import op13_best_fit_packing
from .privacy import op2_personal_data
from .quality import op1_quality_rules
from .search import OP3_SQL, op3_topk_search
from .secrets import op6_secret_scan
from .sentencepiece import op10_sentencepiece
from .suffix_dedup import op5_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_personal_data, op3_topk_search, op4_language_id, op5_suffix_dedup, op6_secret_scan, op7_jaccard_join, op8_katz_scores, op9_pivotal_mixing, op10_sentencepiece, op11_filter_audit, op12_merkle_manifest, op13_best_fit_packing)}
SQL: dict[str, str] = {"op3_topk_search": OP3_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL}

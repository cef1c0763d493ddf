"""The queries of this folder by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from . import hard_negatives, html_text, image_copies, importance, lang_id, mixing, ngram_join, packing, secrets, spotsigs, substring_dedup, token_store, url_filter

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_image_copies": image_copies.op3_image_copies,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_language_id": lang_id.op10_language_id,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_html_extraction": html_text.op12_html_extraction,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op6_url_filter": url_filter.SQL, "op11_hard_negatives": hard_negatives.SQL}

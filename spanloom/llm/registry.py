"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from spanloom.llm import bpe, conversations, fingerprints, html_text, jaccard_join, language_id, line_dedup, mixing, nearest, spelling, substring_dedup, suffix_dedup, url_filters

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_mixing_sources": mixing.op4_mixing_sources,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_bpe_encoding": bpe.op8_bpe_encoding,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_nearest_neighbours": nearest.op10_nearest_neighbours,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op3_url_filters": url_filters.ORACLE,
    "op4_mixing_sources": mixing.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}

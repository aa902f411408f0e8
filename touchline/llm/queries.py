"""The numbered queries of this subpackage and, where SQL can express them, their SQL."""

from . import exact_dedup, html_extract, language, media, mixing, near_dedup, prefix_trie, privacy, segmentation, token_counts, toxicity, url_filter, whitening

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_sentencepiece": segmentation.query,
    "op4_language_id": language.query,
    "op5_near_dedup": near_dedup.query,
    "op6_token_counts": token_counts.query,
    "op7_media_columns": media.query,
    "op8_personal_data": privacy.query,
    "op9_toxicity": toxicity.query,
    "op10_url_filters": url_filter.query,
    "op11_embedding_whitening": whitening.query,
    "op12_html_extraction": html_extract.query,
    "op13_conversation_trie": prefix_trie.query,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_near_dedup": near_dedup.ORACLE_SQL,
    "op10_url_filters": url_filter.ORACLE_SQL,
    "op13_conversation_trie": prefix_trie.ORACLE_SQL,
}

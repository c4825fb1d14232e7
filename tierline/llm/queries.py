"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tierline.llm import bpe_queue, chat_events, credential_links, embed_dedup, html_density, jaccard_join, \
    lang_unigram, lexical_search, mixing, quality_adaptive, sequence_packing, source_divergence, warc

QUERIES = {
    "op1_main_text": html_density.pages_main_text,
    "op2_embedding_dedup": embed_dedup.embedding_near_duplicates,
    "op3_bpe_round_trip": bpe_queue.bpe_round_trip,
    "op4_language_id": lang_unigram.language_id,
    "op5_mix_sources": mixing.mix_documents,
    "op6_warc_round_trip": warc.warc_round_trip,
    "op7_secret_scan": credential_links.secret_scan,
    "op8_jaccard_join": jaccard_join.jaccard_components,
    "op9_quality_rules": quality_adaptive.quality_rules,
    "op10_format_chats": chat_events.format_conversations,
    "op11_pack_sequences": sequence_packing.pack_sequences,
    "op12_source_divergence": source_divergence.source_divergence,
    "op13_lexical_search": lexical_search.search_benchmark,
}

ORACLES = {
    "op2_embedding_dedup": embed_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
    "op9_quality_rules": quality_adaptive.ORACLE,
    "op12_source_divergence": source_divergence.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}

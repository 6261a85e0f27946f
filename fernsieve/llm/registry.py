"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from fernsieve.llm import audio, bpe, conversations, html_text, language, mixing, packing, quality, simhash, spelling, substrings, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": language.op3_language,
    "op4_bpe": bpe.op4_bpe,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_simhash": simhash.op7_simhash,
    "op8_html": html_text.op8_html,
    "op9_audio": audio.op9_audio,
    "op10_substrings": substrings.op10_substrings,
    "op11_mixing": mixing.op11_mixing,
    "op12_conversations": conversations.op12_conversations,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES = {"op1_url_filters": url_filters.ORACLE_SQL, "op10_substrings": substrings.ORACLE_SQL, "op11_mixing": mixing.ORACLE_SQL, "op12_conversations": conversations.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}

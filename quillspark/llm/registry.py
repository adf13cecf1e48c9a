"""The queries of this subpackage and their SQL."""

from . import chat_format, decontaminate, hard_negatives, html_text, jaccard_join, mixing, projection_forest, rule_quality, sentence_spans, sharding, suffix_dedup, url_filter, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_projection_forest": projection_forest.op4_projection_forest,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_sentence_spans": sentence_spans.op7_sentence_spans,
    "op8_rule_quality": rule_quality.op8_rule_quality,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_sharding": sharding.op10_sharding,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_html_text": html_text.op12_html_text,
    "op13_whitening": whitening.op13_whitening,
}

SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_projection_forest": projection_forest.OP4_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}

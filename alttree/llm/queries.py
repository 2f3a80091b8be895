"""The queries of this package, one per operator, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from alttree.llm import alignment, bpe, chat, collocations, jaccard, packing, quality_classifier, quality_rules, sharding, suffix_dedup, toxicity, url_filter, vector_dedup

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_alignment": alignment.op11_alignment,
    "op12_collocations": collocations.op12_collocations,
    "op13_toxicity": toxicity.op13_toxicity,
    "op2_chat_format": chat.op2_chat_format,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_vector_dedup": vector_dedup.op4_vector_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
}
ORACLES = {
    "op12_collocations": collocations.SQL,
    "op2_chat_format": chat.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_sharding": sharding.SQL,
    "op7_quality_rules": quality_rules.SQL,
}

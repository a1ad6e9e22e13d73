"""Queries of this subpackage and their SQL, by registered name."""

from __future__ import annotations

from twinweave.llm import conversation_repair, embedding_dedup, fill_middle, language_id, lm_scoring, mixing, ngram_join, pieces, quality_model, quality_rules, sharding, substring_dedup, word_bpe

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_model": quality_model.op5_quality_model,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_word_bpe": word_bpe.op13_word_bpe,
}

SQL = {
    "op1_embedding_dedup": embedding_dedup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}

"""Registered queries of the operators, and their SQL where SQL can express them."""

from actloom.llm import (
    byte_bpe,
    conversation_repair,
    decontamination,
    html_text,
    language_model,
    near_duplicates,
    packing,
    personal_data,
    quality_rules,
    quality_trees,
    sharding,
    spelling_variants,
    toxicity,
)

QUERIES = {
    "op1_shard_documents": sharding.query,
    "op2_toxic_segments": toxicity.query,
    "op3_quality_rules": quality_rules.query,
    "op4_html_text": html_text.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_decontamination": decontamination.query,
    "op7_personal_data": personal_data.query,
    "op8_near_duplicates": near_duplicates.query,
    "op9_language_model": language_model.query,
    "op10_quality_trees": quality_trees.query,
    "op11_sequence_packing": packing.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_spelling_variants": spelling_variants.query,
}
ORACLES = {
    "op1_shard_documents": sharding.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op8_near_duplicates": near_duplicates.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_spelling_variants": spelling_variants.ORACLE,
}

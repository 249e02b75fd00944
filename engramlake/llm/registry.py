"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from engramlake.llm import byte_bpe, chat_format, decontaminate, fill_in_middle, jaccard_join, language_id, language_model, license_scan, line_dedup, secrets_scan, structure_repair, toxicity, vector_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_license_scan": license_scan.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_decontaminate": decontaminate.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_toxicity": toxicity.query,
    "op7_vector_dedup": vector_dedup.query,
    "op8_secrets_scan": secrets_scan.query,
    "op9_chat_format": chat_format.query,
    "op10_language_id": language_id.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_structure_repair": structure_repair.query,
    "op13_language_model": language_model.query,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_structure_repair": structure_repair.ORACLE,
}

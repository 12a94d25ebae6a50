"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lexmill.llm import bpe, chat, filter_audit, fm_index, kneser_ney, lang_id, lexical, line_rules, secret_scan, shards, simhash, token_spans, winnow

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_lang_id": lang_id.op2,
    "op3_token_counts": token_spans.op3,
    "op4_winnowing": winnow.op4,
    "op5_byte_bpe": bpe.op5,
    "op6_shards": shards.op6,
    "op7_chat_format": chat.op7,
    "op8_decontaminate": fm_index.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_kneser_ney": kneser_ney.op10,
    "op11_lexical_search": lexical.op11,
    "op12_line_rules": line_rules.op12,
    "op13_filter_audit": filter_audit.op13,
}
ORACLES: dict[str, str] = {
    "op6_shards": shards.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op8_decontaminate": fm_index.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_line_rules": line_rules.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}

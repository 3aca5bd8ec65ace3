"""Queries of the training-data operators, by name, and DuckDB SQL for those that SQL can express."""

from . import chat, decision_list, elkan, html_tree, overlap, pieces, pu_quality, ranked, reputation, simhash, toxicity, warc, winnowing

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_pieces": pieces.op2_pieces,
    "op3_chat": chat.op3_chat,
    "op4_html": html_tree.op4_html,
    "op5_rules": decision_list.op5_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": pu_quality.op7_quality,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_reputation": reputation.op9_reputation,
    "op10_simhash": simhash.op10_simhash,
    "op11_elkan": elkan.op11_elkan,
    "op12_ranked": ranked.op12_ranked,
    "op13_overlap": overlap.op13_overlap,
}
ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op8_winnowing": winnowing.ORACLE_SQL,
    "op9_reputation": reputation.ORACLE_SQL,
    "op11_elkan": elkan.ORACLE_SQL,
    "op12_ranked": ranked.ORACLE_SQL,
    "op13_overlap": overlap.ORACLE_SQL,
}

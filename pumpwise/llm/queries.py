"""The registered queries of this subpackage and their SQL; those without SQL are tested against brute force."""

from pumpwise.llm import chat, decontaminate, exact_dedup, hard_negatives, html_text, langid, line_dedup, mixing, periodic, quality, secrets, sharding, simhash

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality": quality.op2_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_sharding": sharding.op4_sharding,
    "op5_simhash": simhash.op5_simhash,
    "op6_chat_format": chat.op6_chat_format,
    "op7_langid": langid.op7_langid,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_html_text": html_text.op11_html_text,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_sharding": sharding.SQL,
    "op6_chat_format": chat.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_mixing": mixing.SQL,
    "op11_html_text": html_text.op11_html_text,
    "op12_hard_negatives": hard_negatives.SQL,
}

"""The queries of this subpackage and the SQL that expresses them, where SQL can."""

from __future__ import annotations

from marlstone.llm import audit, chat, decontaminate, fim, flac, license_scan, mixing, packing, quality, simhash, token_count, url_filter, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_chat": chat.op2_chat,
    "op3_warc": warc.op3_warc,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality": quality.op5_quality,
    "op6_license": license_scan.op6_license,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_media": flac.op9_media,
    "op10_token_counts": token_count.op10_token_counts,
    "op11_packing": packing.op11_packing,
    "op12_fim": fim.op12_fim,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_license": license_scan.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op12_fim": fim.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}

"""The queries of this subpackage and their DuckDB SQL."""

from . import chat, collocations, decontaminate, near_dedup, pieces, pii, quality, repair, secrets, token_files, topk, url_filter, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_warc": warc.op2_warc,
    "op3_pieces": pieces.op3_pieces,
    "op4_topk": topk.op4_topk,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_chat": chat.op9_chat,
    "op10_pii": pii.op10_pii,
    "op11_token_files": token_files.op11_token_files,
    "op12_collocations": collocations.op12_collocations,
    "op13_repair": repair.op13_repair,
}
SQL = {
    "op1_secrets": secrets.SQL,
    "op2_warc": warc.SQL,
    "op4_topk": topk.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_chat": chat.SQL,
    "op12_collocations": collocations.SQL,
    "op13_repair": repair.SQL,
}

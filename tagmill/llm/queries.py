"""The queries of this subpackage and, where SQL can say it, their oracles."""

from tagmill.llm import ann, bpe, chat, dedup, langid, lm, mixing, sharding, topk, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ann": ann.op2_ann,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sharding": sharding.op4_sharding,
    "op5_chat": chat.op5_chat,
    "op6_langid": langid.op6_langid,
    "op7_bpe": bpe.op7_bpe,
    "op8_dedup": dedup.op8_dedup,
    "op9_topk": topk.op9_topk,
    "op10_lm": lm.op10_lm,
}

ORACLES = {
    "op3_url_filter": url_filter.op3_sql,
    "op4_sharding": sharding.op4_sql,
    "op5_chat": chat.op5_sql,
    "op8_dedup": dedup.op8_sql,
    "op9_topk": topk.op9_sql,
}

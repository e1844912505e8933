"""The corpus queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, packing, quality, sharding, suffix_dedup, token_files, url_filter, warc


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_warc": warc.op4_warc,
        "op5_chat_format": chat.op5_chat_format,
        "op6_retrieval_packing": packing.op6_retrieval_packing,
        "op7_weak_supervision": quality.op7_weak_supervision,
        "op8_token_files": token_files.op8_token_files,
        "op9_feistel_shards": sharding.op9_feistel_shards,
        "op10_url_reputation": url_filter.op10_url_reputation,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op3_jaccard_join": jaccard.SQL,
        "op4_warc": warc.SQL,
        "op5_chat_format": chat.SQL,
        "op10_url_reputation": url_filter.SQL,
    }

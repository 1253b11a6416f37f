"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balltree, bpe, chat, decontaminate, importance, multiindex, pii, quality, simhash, substrings, tokenfile, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_quality": quality.op3_quality,
    "op4_chat": chat.op4_chat,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_substrings": substrings.op6_substrings,
    "op7_token_planes": tokenfile.op7_token_planes,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_urls": urls.op10_urls,
    "op11_importance": importance.op11_importance,
    "op12_multiindex": multiindex.op12_multiindex,
    "op13_balltree": balltree.op13_balltree,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": chat.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op10_urls": urls.OP10_SQL,
    "op11_importance": importance.OP11_SQL,
    "op12_multiindex": multiindex.OP12_SQL,
    "op13_balltree": balltree.OP13_SQL,
}

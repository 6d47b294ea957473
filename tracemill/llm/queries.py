"""The subpackage's queries and, where SQL can express them, their SQL for an independent engine."""

from __future__ import annotations

from tracemill.llm import bpe, chat, decontaminate, langid, merkle, mixing, ngram_join, order_minhash, quality, sharding
from tracemill.llm import substring_dedup, toxicity, trie

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_bpe": bpe.op2_bpe,
    "op3_fingerprints": order_minhash.op3_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat": chat.op5_chat,
    "op6_quality": quality.op6_quality,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language": langid.op10_language,
    "op11_manifest": merkle.op11_manifest,
    "op12_mixing": mixing.op12_mixing,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op5_chat": chat.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op11_manifest": merkle.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}

"""The queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bigru_langid, chat_template, chunk_store, ftrl_toxicity, knn_quality, minhash_forest, monoid_bpe, positional_index, prefix_tree_join, prefix_trie, rule_ledger, structure_repair, url_rules
from .common import Query

QUERIES: dict[str, Query] = {
    "op1_knn_quality": knn_quality.query,
    "op2_chunk_store": chunk_store.query,
    "op3_positional_index": positional_index.query,
    "op4_prefix_tree_join": prefix_tree_join.query,
    "op5_url_rules": url_rules.query,
    "op6_ftrl_toxicity": ftrl_toxicity.query,
    "op7_rule_ledger": rule_ledger.query,
    "rule_ablations": rule_ledger.ablation_query,
    "op8_bigru_langid": bigru_langid.query,
    "op9_chat_template": chat_template.query,
    "op10_monoid_bpe": monoid_bpe.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_structure_repair": structure_repair.query,
    "op13_minhash_forest": minhash_forest.query,
}

ORACLES: dict[str, str] = {
    "op3_positional_index": positional_index.ORACLE,
    "op5_url_rules": url_rules.ORACLE,
    "op7_rule_ledger": rule_ledger.ORACLE,
    "rule_ablations": rule_ledger.ABLATION_ORACLE,
    "op9_chat_template": chat_template.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_structure_repair": structure_repair.ORACLE,
}

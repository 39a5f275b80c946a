"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from relcheck.llm import bpe, curriculum, decontaminate, importance, jaccard_join, license_scan, line_dedup, pii, pitman_yor, prefix_trie, quality_rules, sharding, suffix_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_sharding": sharding.op3_sharding,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_lm_scores": pitman_yor.op5_lm_scores,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_pii": pii.op8_pii,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_mixing": curriculum.op11_mixing,
    "op12_resampling": importance.op12_resampling,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_mixing": curriculum.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}

"""The queries of this subpackage, by the names that the driver calls them by."""

from __future__ import annotations

from . import best_two_fit, bpe_verify, fim_units, fm_decontam, hash_tree, langid, license_scan, line_dedup, lm_diff, merkle_pregel, ngram_join, pii_boost, quality_bands

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_compression_bands": quality_bands.op3_compression_bands,
    "op4_language_id": langid.op4_language_id,
    "op5_pii_boosting": pii_boost.op5_pii_boosting,
    "op6_lm_difference": lm_diff.op6_lm_difference,
    "op7_hash_tree": hash_tree.op7_hash_tree,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_fm_decontamination": fm_decontam.op9_fm_decontamination,
    "op10_bpe_encode": bpe_verify.op10_bpe_encode,
    "op11_best_two_fit": best_two_fit.op11_best_two_fit,
    "op12_merkle_pregel": merkle_pregel.op12_merkle_pregel,
    "op13_fim_units": fim_units.op13_fim_units,
}
SQL = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op7_hash_tree": hash_tree.SQL,
    "op9_fm_decontamination": fm_decontam.SQL,
    "op12_merkle_pregel": merkle_pregel.SQL,
    "op13_fim_units": fim_units.SQL,
}

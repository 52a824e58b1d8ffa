"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, jaccard, license, quality, secret, substring, suffix_tree, unigram, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_license_scan": license.op2_license_scan,
    "op3_warc": warc.op3_warc,
    "op4_secret_scan": secret.op4_secret_scan,
    "op5_lm_score": suffix_tree.op5_lm_score,
    "op6_bpe": bpe.op6_bpe,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_token_counts": unigram.op8_token_counts,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_substring_dedup": substring.op10_substring_dedup,
    # the columns of three of them that SQL can express
    "quality_counts": quality.quality_counts,
    "secret_bases": secret.secret_bases,
    "lm_bases": suffix_tree.lm_bases,
}

ORACLES = {
    "op2_license_scan": license.ORACLE,
    "op3_warc": warc.ORACLE,
    "op9_ngram_jaccard": jaccard.ORACLE,
    "op10_substring_dedup": substring.ORACLE,
    "quality_counts": quality.COUNTS_ORACLE,
    "secret_bases": secret.BASES_ORACLE,
    "lm_bases": suffix_tree.BASES_ORACLE,
}

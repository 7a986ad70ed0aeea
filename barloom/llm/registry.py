"""The queries of this package and their oracle SQL."""

from __future__ import annotations

from barloom.llm import bpe, decontamination, exact_dedup, filter_audit, html_extract, language_id, merkle_manifest, minhash_dedup, ngram_join, secret_scan, substring_dedup, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_bpe": bpe.op2_bpe,
        "op3_html_extraction": html_extract.op3_html_extraction,
        "op4_language_id": language_id.op4_language_id,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
        "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op6_secret_scan": secret_scan.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op9_suffix_dedup": suffix_dedup.ORACLE,
        "op10_decontamination": decontamination.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_minhash_dedup": minhash_dedup.ORACLE,
        "op13_merkle_manifest": merkle_manifest.ORACLE,
    }

"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from periodica.llm import (
    conversation_trie,
    decontamination,
    hard_negatives,
    html_extraction,
    license_scan,
    packing,
    quality_rules,
    secret_scan,
    simhash_dedup,
    source_mixing,
    suffix_dedup,
    token_counts,
    warc_archive,
)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_html_extraction": html_extraction.op2_html_extraction,
        "op3_packing": packing.op3_packing,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_warc_archive": warc_archive.op5_warc_archive,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_source_mixing": source_mixing.op11_source_mixing,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    }


def oracle_sql() -> dict:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op5_warc_archive": warc_archive.ORACLE,
        "op11_source_mixing": source_mixing.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_conversation_trie": conversation_trie.ORACLE,
    }

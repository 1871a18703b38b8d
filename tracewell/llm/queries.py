"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tracewell.llm import collocations, decontamination, jaccard_join, language_id, mixing, pieces, preference, quality_classifier, quality_rules, source_audit, surrogates, token_files, warc


def queries() -> dict:
    return {
        "op1_warc_bundles": warc.query,
        "op2_preference_pairs": preference.query,
        "op3_language_id": language_id.query,
        "op4_jaccard_join": jaccard_join.query,
        "op5_token_files": token_files.query,
        "op6_surrogates": surrogates.query,
        "op7_source_mixing": mixing.query,
        "op8_quality_classifier": quality_classifier.query,
        "op9_decontamination": decontamination.query,
        "op10_quality_rules": quality_rules.query,
        "op11_collocations": collocations.query,
        "op12_source_audit": source_audit.query,
        "op13_sentencepiece": pieces.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_bundles": warc.ORACLE,
        "op2_preference_pairs": preference.ORACLE,
        "op4_jaccard_join": jaccard_join.ORACLE,
        "op7_source_mixing": mixing.ORACLE,
        "op9_decontamination": decontamination.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op12_source_audit": source_audit.ORACLE,
    }

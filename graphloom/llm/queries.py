"""The driver's entry points of this subpackage."""

from __future__ import annotations

from . import decontaminate, licenses, mixing, nearjoin, quality, secrets, substrings, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": nearjoin.op1_ngram_jaccard_join,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_warc": warc.op6_warc,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_token_output": tokens.op8_token_output,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are held against brute force in the tests."""
    return {
        "op1_ngram_jaccard_join": nearjoin.oracle(),
        "op2_substring_dedup": substrings.oracle(),
        "op3_decontaminate": decontaminate.oracle(),
        "op7_quality_rules": quality.oracle(),
        "op9_license_scan": licenses.oracle(),
    }

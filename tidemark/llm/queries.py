"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, decontam, fingerprint, html, langid, licenses, neardup, quality, toxicity, warc

QUERIES = {
    "op1_benchmark_decontamination": decontam.query,
    "op2_warc": warc.query,
    "op3_language_id": langid.query,
    "op4_toxicity": toxicity.query,
    "op5_quality_classifier": quality.query,
    "op6_fingerprints": fingerprint.query,
    "op7_license_scan": licenses.query,
    "op8_byte_bpe": bpe.query,
    "op9_minhash_near_dedup": neardup.query,
    "op10_html_extraction": html.query,
}
ORACLE_SQL = {
    "op1_benchmark_decontamination": decontam.SQL,
    "op2_warc": warc.SQL,
    "op7_license_scan": licenses.SQL,
    "op9_minhash_near_dedup": neardup.SQL,
}

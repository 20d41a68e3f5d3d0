"""The registered query of each operator and the SQL twins of those that SQL can express."""

from __future__ import annotations

from chartloom.llm import (
    classifier, filter_audit, fingerprints, infill, mixing, pieces, pii, quality, shards, simhash, token_files, urls, warc,
)

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_pieces": pieces.op2_pieces,
    "op3_quality_classifier": classifier.op3_quality_classifier,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_shards": shards.op5_shards,
    "op6_token_files": token_files.op6_token_files,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_url_filter": urls.op10_url_filter,
    "op11_infill": infill.op11_infill,
    "op12_warc": warc.op12_warc,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op10_url_filter": urls.ORACLE,
    "op11_infill": infill.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}

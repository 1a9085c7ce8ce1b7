"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from palimpsest.llm import decontamination, hard_negatives, line_dedup, ngram_join, quality_rules, secrets, warc
from palimpsest.llm.bpe import op10_bpe_roundtrip
from palimpsest.llm.compression_classifier import op6_compression_classifier
from palimpsest.llm.importance_resampling import op11_importance_resampling
from palimpsest.llm.license_scan import op7_license_scan
from palimpsest.llm.packing import op13_packing
from palimpsest.llm.token_counts import op3_token_counts

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_warc": warc.op5_warc,
    "op6_compression_classifier": op6_compression_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_packing": op13_packing,
    # parts of operators 2 and 9, for the sake of their SQL
    "secret_patterns": secrets.secret_patterns,
    "quality_statistics": quality_rules.quality_statistics,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "secret_patterns": secrets.BASE_ORACLE,
    "quality_statistics": quality_rules.BASE_ORACLE,
}

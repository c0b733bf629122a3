"""The queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from corpusloom.llm import bpe, decontaminate, fingerprints, langid, line_dedup, lm, near_dedup, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": langid.op2_language_id,
    "op3_lm_scores": lm.op3_lm_scores,
    "op4_warc": warc.op4_warc,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
ORACLES = {
    "op4_warc": warc.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_url_filters": url_filters.SQL,
    "op10_near_dedup": near_dedup.SQL,
}

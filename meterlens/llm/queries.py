"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from meterlens.llm import (
    decontamination,
    html_template,
    importance,
    language_id,
    line_dedup,
    minhash,
    mixing,
    packing,
    periodic_runs,
    piece_codec,
    quality_rules,
    token_alignment,
    warc_zst,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_importance_resampling": importance.op2_importance_resampling,
    "op3_ecoc_language_id": language_id.op3_ecoc_language_id,
    "op4_warc_dictionary": warc_zst.op4_warc_dictionary,
    "op5_bfd_packing": packing.op5_bfd_packing,
    "op6_fm_decontamination": decontamination.op6_fm_decontamination,
    "op7_segment_line_dedup": line_dedup.op7_segment_line_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_minmax_near_dedup": minhash.op9_minmax_near_dedup,
    "op10_html_template": html_template.op10_html_template,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_piece_codec": piece_codec.op13_piece_codec,
}
ORACLES = {
    "op1_quality_rules": quality_rules.SQL,
    "op6_fm_decontamination": decontamination.SQL,
    "op8_mixing": mixing.SQL,
}

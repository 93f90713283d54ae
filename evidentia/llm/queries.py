"""Queries of the training-data operators and the SQL that must give the same rows."""

from __future__ import annotations

from . import bpe, mixing, neardup, packing, pii, quality, substring, topk, warc, wavelet

QUERIES = {
    "op1_warc": warc.op1_warc_round_trip,
    "op2_quality": quality.op2_quality_rules,
    "op3_wavelet": wavelet.op3_wavelet_tokens,
    "op4_packing": packing.op4_packed_sequences,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_bpe_counts": bpe.op6_token_counts,
    "op7_surrogates": pii.op7_surrogates,
    "op8_top_k": topk.op8_top_k,
    "op9_repeated_passages": substring.op9_repeated_passages,
    "op10_mixing": mixing.op10_mixing,
}

#: No SQL has the tokenizers (op3, op4, op6), the keyed permutation (op7) or the dual's solution (op10).
ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_quality": quality.ORACLE,
    "op5_near_duplicates": neardup.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op9_repeated_passages": substring.ORACLE,
}

"""Queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from cutline.llm import (
    alignment, bpe, exact_dedup, line_dedup, mil_quality, mixing, ngram_join, packing, secrets, spelling, toxicity, vp_search, warc,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_vantage_point_search": vp_search.op4_vantage_point_search,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_classifier": mil_quality.op6_quality_classifier,
    "op7_warc": warc.op7_warc,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_source_mix": mixing.op11_source_mix,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op11_source_mix": mixing.SQL, "op13_spelling_variants": spelling.SQL}

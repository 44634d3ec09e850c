"""Queries of this package, and the DuckDB SQL of those that SQL can express."""

from veritrail.llm import fingerprints, lloyd, mixing, near_duplicates, neighbours, packing, phrases, quality, substring_dedup, suffix_dedup, token_counts, topk, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_ngram_jaccard_join": near_duplicates.query,
    "op3_token_counts": token_counts.query,
    "op4_quality_classifier": quality.query,
    "op5_mixing": mixing.query,
    "op6_warc": warc.query,
    "op7_exact_topk": topk.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_suffix_array_dedup": suffix_dedup.query,
    "op10_fingerprints": fingerprints.query,
    "op11_collocations": phrases.query,
    "op12_nearest_neighbours": neighbours.query,
    "op13_lloyd_codes": lloyd.query,
}
ORACLES = {
    "op2_ngram_jaccard_join": near_duplicates.SQL,
    "op6_warc": warc.SQL,
    "op7_exact_topk": topk.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_suffix_array_dedup": suffix_dedup.SQL,
    "op11_collocations": phrases.SQL,
    "op13_lloyd_codes": lloyd.SQL,
}

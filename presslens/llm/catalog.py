"""Queries of the text operators, and their SQL where there is one."""

from presslens.llm import align, audit, language, mixing, near, packing, quality, secrets, sharding, spots, tokens, topk, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_pack_sequences": packing.op4_pack_sequences,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_hilbert_shards": sharding.op7_hilbert_shards,
    "op8_ngram_jaccard": near.op8_ngram_jaccard,
    "op9_spot_fingerprints": spots.op9_spot_fingerprints,
    "op10_language": language.op10_language,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE = {"op1_mix_sources": mixing.OP1_SQL, "op11_filter_audit": audit.OP11_SQL}

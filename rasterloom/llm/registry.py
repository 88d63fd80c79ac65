"""The queries of the text operators, and their SQL where SQL can express them."""

from . import exact_dedup, langid, mixing, near_dedup, ngram_lm, packing, repeats, secrets, topk, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_exact_topk": topk.query,
    "op4_ngram_lm": ngram_lm.query,
    "op5_language_id": langid.query,
    "op6_toxicity": toxicity.query,
    "op7_repeats": repeats.query,
    "op8_secret_scan": secrets.query,
    "op9_harmonic_packing": packing.query,
    "op10_pfair_mixing": mixing.query,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_exact_topk": topk.ORACLE_SQL,
    "op10_pfair_mixing": mixing.ORACLE_SQL,
}

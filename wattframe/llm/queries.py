"""The queries of this subpackage and their SQL, by name."""

from . import bestfit, jaccard, mixing, packing, phrases, quality, secrets, sharding, substring, suffixarray, topk, variants, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_sharding": sharding.op2_sharding,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_warc": warc.op4_warc,
    "op5_substring": substring.op5_substring,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_array": suffixarray.op8_suffix_array,
    "op9_secrets": secrets.op9_secrets,
    "op10_topk": topk.op10_topk,
    "op11_phrases": phrases.op11_phrases,
    "op12_best_fit": bestfit.op12_best_fit,
    "op13_variants": variants.op13_variants,
}
SQL = {"op1_quality_rules": quality.SQL, "op4_warc": warc.SQL, "op7_mixing": mixing.SQL, "op10_topk": topk.SQL, "op11_phrases": phrases.SQL}

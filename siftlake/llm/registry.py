"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from . import exact_dedup, host_reputation, lm_scoring, minhash_dedup, mixing, multi_index, packing, substring_dedup, toxicity, warc

QUERIES = {
    "op1_packing": packing.query,
    "op10_substring_dedup": substring_dedup.query,
    "op2_multi_index": multi_index.query,
    "op3_mixing": mixing.query,
    "op4_lm_scoring": lm_scoring.query,
    "op5_warc": warc.query,
    "op6_host_reputation": host_reputation.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_minhash_dedup": minhash_dedup.query,
    "op9_toxicity": toxicity.query,
}

ORACLE = {
    "op10_substring_dedup": substring_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op5_warc": warc.SQL,
    "op6_host_reputation": host_reputation.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
}

"""The queries of this subpackage and their SQL."""

from . import bpe, exact_dedup, lm, mixing, neighbours, secrets, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_secrets": secrets.op3_secrets,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_bpe": bpe.op6_bpe,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_lm": lm.op9_lm,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "secrets_base": secrets.secrets_base,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "secrets_base": secrets.BASE_SQL,
}

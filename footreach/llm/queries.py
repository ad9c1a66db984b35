"""The named queries of this package and their SQL: opN_<name> for each operator N."""

from __future__ import annotations

from footreach.llm import chat, decontam, dedup, jaccard_join, licenses, packing, quality, ranking, repair, secrets, tokens, toxicity, urls, urls_sql

QUERIES = {
    "op1_compression_bands": quality.op1,
    "op2_transducer_counts": tokens.op2,
    "op3_ftrl_toxicity": toxicity.op3,
    "op4_positional_index": decontam.op4,
    "op5_suffix_automaton": licenses.op5,
    "op6_path_templates": urls.op6,
    "op7_conflict_packing": packing.op7,
    "op8_lsh_forest": dedup.op8,
    "op9_secret_ownership": secrets.op9,
    "op10_typed_parts": chat.op10,
    "op11_auction_repair": repair.op11,
    "op12_dense_ranking": ranking.op12,
    "op13_metric_join": jaccard_join.op13,
}
ORACLES = {
    "op6_path_templates": urls_sql.OP6_SQL,
    "op10_typed_parts": chat.OP10_SQL,
    "op11_auction_repair": repair.OP11_SQL,
    "op12_dense_ranking": ranking.OP12_SQL,
}

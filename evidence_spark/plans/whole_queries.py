"""Second names of queries that once answered a fixed part of the input, for callers that still use them; `queries()` has the first ones."""

from __future__ import annotations

from evidence_spark.plans.base import ORACLES, QUERIES

WHOLE = (
    "vec_cosine_topn", "fus_rrf", "fus_round_robin", "evl_ranking_metrics", "vec_search_members", "vec_apply_rerank", "vec_build_context", "lex_repair_dense", "fus_scope_filter",
    "fus_select_evidence", "fus_expand_parents", "fus_coverage_warnings", "fus_retrieval_grid", "lex_bm25", "grf_relations_for_query", "grf_two_hop_paths", "trn_ranking_rows",
)

for _name in WHOLE:
    QUERIES[f"{_name}_whole"] = QUERIES[_name]
    if _name in ORACLES:
        ORACLES[f"{_name}_whole"] = ORACLES[_name]

"""Every registered query of the core, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import queries as q
from corpusmill.plans.sql import SQL as SQL

_NAMES = """
bm25_search bm25_scores bm25_batch bm25_doc_freq bm25_idf bm25_vocab_stats query_type
bm25_index_stats bm25_incremental vector_ivf_exact vector_ivf_topk
vector_l2_topk vector_l2_filtered vector_cosine_topk hybrid_search hybrid_compat hybrid_batch
line_chunks chunk_id_md5 classify code_metrics chunk_lines entity_list ast_chunks text_split embed_hash
text_contains text_contains_first search_in_file file_summary
graph_nodes graph_edges graph_stats graph_related graph_file_structure graph_file_chain graph_dependencies graph_hierarchy
graph_node_details graph_degree graph_khop graph_call_depth edge_upsert_merge node_upsert prefix_delete
edge_upsert_override chunk_delete_prefix chunk_reindex
graph_enhance rerank_features rerank_features_calls graph_rerank
conflict_detection conflict_resolution conflict_semantic conflict_keyword
stream_event_windows batch_event_windows stream_latest_chunks
""".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(q, n) for n in _NAMES}

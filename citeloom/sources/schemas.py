"""Fixed schemas of what is read and written; nothing is inferred."""

from __future__ import annotations

RAW_HIT = "caseName string, dateFiled string, court_id string, cluster_id bigint, opinions array<struct<id: bigint, plain_text: string, download_url: string>>, citation array<string>, citeCount int, docketNumber string, status string"
CASE = "case_id bigint, cluster_id bigint, case_name string, date_filed string, court_id string, citations array<string>, plain_text string, opinions_cited array<string>, cite_count int, docket_number string, status string"
BENCHMARK = "benchmark_id bigint, citation string, context string, label string, subtype string, case_id bigint, court_id string, year string, original_citation string, corrupted_year string, corrupted_court string, corruption_type string"
RAW_SCORES = (
    "benchmark_id bigint, label string, subtype string, corruption_type string, `exists` boolean, rrf_score double, dense_score double, case_sim double, density_score int, pagerank_score double, metadata_valid boolean, meta_checked boolean, "
    "name_score double, name_checked boolean, temporal_valid boolean, temporal_checked boolean, temporal_reason string, llm_accurate boolean, llm_checked boolean"
)

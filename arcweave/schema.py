"""Schemas of the link-graph tables."""

from __future__ import annotations

EDGES = "edge_id bigint, src string, dst string"
NODES = "title string, is_base boolean, processed_at bigint"
LINKS = "src string, dst string, weight bigint, created_at bigint, last_updated bigint"
LINK_DOCUMENT = "LINKS_TO array<struct<`from`:string,`to`:string>>"
PAGE_ENTITIES = "title string, entities array<string>"
METRICS = (
    "algorithm_name string, scenario string, run_number int, thread_count int, batch_size int, total_time double, throughput double, "
    "success_rate double, processing_overhead double, conflicts bigint, system_cores_avg double, db_insertion_time_total double, db_lock_wait_time double"
)

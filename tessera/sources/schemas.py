"""Tables of the registry, and domains of their columns."""

from __future__ import annotations

#: Schemas as DDL.
SCHEMAS: dict[str, str] = {
    "business_records": "id string, source_system string, source_record_id string, business_name string, address_line string, address_locality string, address_city string, address_district string, address_pincode string, address_state string, pan string, gstin string, phone string, email string, registration_date date, registration_type string, content_hash string, ingested_at timestamp, gt_id string",
    "ubid_master": "ubid string, anchor_type string, anchor_value string, primary_name string, primary_address string, primary_pincode string, primary_district string, status string, deprecated_by_ubid string, created_at timestamp, updated_at timestamp",
    "ubid_source_records": "id bigint, ubid string, source_system string, source_record_id string, record_id string, content_hash string, joined_at timestamp",
    "merge_provenance": "merge_id string, ubid_winner string, ubid_loser string, score double, model_version string, decided_by string, decided_at timestamp, feature_breakdown string, reversed boolean",
    "merge_reversals": "reversal_id string, merge_id string, reason string, reversed_by string, reversed_at timestamp",
    "candidate_pairs": "id string, record_a_id string, record_b_id string, blocking_keys array<string>, score double, decision string, feature_breakdown struct<anchor_score:double,name_score:double,address_score:double,contact_score:double,date_proximity_score:double>, model_version string, decided_at timestamp, review_status string, reviewer_id string, reviewer_notes string, reviewed_at timestamp, created_at timestamp, content_key bigint",
    "review_decisions": "pair_id string, decision string, reviewer_id string, notes string, reviewed_at timestamp, said_at bigint",
    "activity_events": "id string, ubid string, source_system string, source_event_id string, event_type string, signal_class string, event_date date, payload string, ingested_at timestamp, joined_at timestamp",
    "activity_status_current": "ubid string, status string, score double, last_strong_active_at timestamp, status_since timestamp, last_recomputed_at timestamp, event_count int, last_event_date date",
    "event_ledger": "ledger_id bigint, event_type string, aggregate_type string, aggregate_id string, payload string, prev_hash string, hash string, created_at timestamp",
    "query_audit": "id string, query_type string, query_params string, result_count int, latency_ms double, executed_at timestamp",
    "search_documents": "ubid string, primary_name string, name_variants array<string>, anchor_type string, anchor_value string, primary_pincode string, primary_district string, status string, activity_score double, source_record_count bigint",
    "search_postings": "term string, ubid string, field string, bucket int",
    "search_keys": "key string, field string, term string, bucket int",
    "pair_filter": "block bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, b4 bigint, b5 bigint, b6 bigint, b7 bigint",
    "adapter_health": "source_system string, last_successful_pull_at timestamp, last_record_count int, total_records int, last_error string, freshness_seconds double, status string, updated_at timestamp",
}
# Domains.
DOMAINS = {
    "source_system": ["SHOP_EST", "FACTORIES", "LABOUR", "KSPCB", "GST"],
    "activity_status": ["ACTIVE", "DORMANT", "CLOSED"],
    "decision": ["AUTO_LINK", "REVIEW", "HOLD"],
    "review_decision": ["CONFIRM", "REJECT", "ESCALATE"],
    "signal_class": ["STRONG_ACTIVE", "WEAK_ACTIVE", "NEUTRAL", "DORMANCY", "CLOSURE"],
    "anchor_type": ["PAN", "GSTIN", "INTERNAL"],
}

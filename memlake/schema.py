"""Canonical table schemas of the event memory."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

DDL = {
    "entities": "entity_id string, type string, label string, created_at double, status string",
    "signatures": "sig_id string, entity_id string, kind string, dim int, vec array<float>, created_at double",
    "locations": "location_id string, name string, polygon array<struct<x:double,y:double>>, camera_id string",
    "observations": (
        "observation_id string, seq bigint, subject_entity_id string, predicate string, object_entity_id string,"
        " location_id string, ts double, confidence double, source_ref string, origin string, camera_id string,"
        " user_id string, status string, assignee string, description_id string, text string, received_at timestamp"
    ),
    "scene_descriptions": (
        "description_id string, camera_id string, location_id string, ts double, source_ref string, model string,"
        " raw string, text string"
    ),
    "scene_snapshots": (
        "snapshot_id string, seq bigint, location_id string, ts double, present_entity_ids array<string>"
    ),
    "relations": (
        "relation_id string, kind string, subject_entity_id string, predicate string, object_entity_id string,"
        " location_id string, weight double, supporting_observation_ids array<string>, n_evidence bigint, last_reinforced_at double,"
        " created_at double, status string"
    ),
    "predicate_schema": "predicate string, subject_type string, object_type string, canonical string",
    "text_embeddings": "kind string, ref_id string, model string, dim int, vec array<float>, created_at double",
    "conversations": (
        "conversation_id string, user_id string, title string, created_at double, updated_at double"
    ),
    "chat_turns": (
        "turn_id string, seq bigint, conversation_id string, asked_at double, question string, answer string,"
        " payload string, latency_ms int, n_entities int, n_observations int, n_keyframes int, n_rule_events int"
    ),
    "cases": "case_id string, title string, status string, created_at double, updated_at double",
    "case_items": "case_id string, kind string, ref_id string, note string, added_at double",
    "reports": "report_id string, title string, fmt string, since double, until double, created_at double, body string",
    "documents": (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, camera_id string,"
        " written_at timestamp"
    ),
    "eval_items": "item_id bigint, suite string, text string",
    "doc_labels": "doc_id bigint, toxic int, reviewer string, labelled_at timestamp",
}

@cache
def schema(name: str) -> StructType:
    """The StructType of a canonical table (needs a running session)."""
    return StructType.fromDDL(DDL[name])

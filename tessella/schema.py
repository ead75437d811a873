"""The relational model: one schema for each table, and empty tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType

_DDL = {
    "entries": "path string, parent_path string, kind string, size bigint, modified_s bigint, hint_label string, hint_cat string, deep_policy string, indexed_at bigint, first_indexed_at bigint, scan_generation bigint",
    "chunks": "id bigint, entry_path string, seq bigint, heading string, text string, language string, embedding array<float>, embed_model string, content_hash string, indexed_at bigint",
    "summaries": "path string, kind string, parent_path string, depth bigint, summary string, summary_l0 string, embedding array<float>, child_count bigint, byte_size bigint, model string, source_hash string, generated_at bigint, provider string, passes bigint, fallback boolean",
    "summary_queue": "path string, kind string, depth bigint, state string, attempts bigint, enqueued_at bigint, updated_at bigint, error string",
    "classifications": "path string, kind string, category string, confidence double, source string, confirmed_at bigint, created_at bigint",
    "directory_apps": "path string, app_kind string, app_name string, family string, specificity bigint, is_primary boolean, markers_json string, source string, detected_at bigint",
    "edges": "from_path string, kind string, to_ref string",
    "symbols": "path string, name string, kind string, start_line bigint, end_line bigint",
    "note_anchors": "note_path string, anchor string, anchor_kind string, title string, pack string",
    "co_change": "path_a string, path_b string, count bigint, computed_at bigint",
    "graph_modules": "module_id bigint, member_path string, label string, cohesion double, computed_at bigint",
    "packs": "id string, name string, description string, created_at bigint",
    "pack_paths": "pack_id string, path string",
    "pack_events": "id bigint, pack_id string, event string, detail string, at bigint",
    "importance_weights": "target_kind string, target string, weight double, source string, reason string, updated_at bigint",
    "saved_queries": "name string, question string, mode string, scope string, created_at bigint",
    "conversation_turns": "session_id string, turn_index bigint, question string, answer string, sources_json string, created_at bigint",
    "tool_usage": "id bigint, surface string, tool string, bytes_served bigint, bytes_counterfactual bigint, at bigint, session_id string, served_basis string",
    "decisions": "id bigint, decision_type string, subject string, params string, options string, auto_value string, chosen string, source string, confidence double, evidence_hash string, priority bigint, status string, parent_id bigint, superseded_by bigint, effects string, effects_applied_at bigint, created_at bigint, decided_at bigint",
    "decision_paths": "decision_id bigint, path string",
    "hits": "chunk_id bigint, entry_path string, seq bigint, heading string, text string, rrf_score double",
}

_TYPES = {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "array<float>": ArrayType(FloatType())}

SCHEMAS: dict[str, StructType] = {
    name: StructType([StructField(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in ddl.split(", ")]) for name, ddl in _DDL.items()
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])

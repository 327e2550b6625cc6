"""Domain table schemas: declared tables and implied ones.

JSONB columns with a documented shape are structs/arrays; free-form JSON
(``video_env``, ``llm_response``, ``raw_json``) is VARIANT. Use these with
``spark.read.schema(...)`` so a scan never infers types from data.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

ALT_DIAGRAM = "struct<id:string,t:string,score:int>"
APPLIED_MOD = "struct<n:string,v:int,tg:string,applied:boolean>"
LAW = "struct<a:string,d:string>"
MODIFIER_DETAIL = "struct<name:string,target:string,value:int,reason:string>"

DDL = {
    # declared tables
    "analyses": (
        "id string, created_at timestamp, input_text string, input_type string, has_pdf boolean, "
        "has_image boolean, has_video boolean, pdf_text string, ocr_text string, video_env variant, "
        "diagram_id string, diagram_title string, category string, subcategory string, confidence string, "
        f"match_score int, alt_diagrams array<{ALT_DIAGRAM}>, fault_a int, fault_b int, label_a string, "
        "label_b string, base_fault_a int, base_fault_b int, detected_mods array<string>, "
        f"applied_mods array<{APPLIED_MOD}>, laws array<{LAW}>, analysis_text string, llm_used boolean, "
        "llm_response variant, session_id string, user_agent string, ip_hash string"),
    "feedback": (
        "id string, analysis_id string, created_at timestamp, is_correct boolean, correct_diagram string, "
        "correct_fault_a int, correct_fault_b int, comment string, expert_level string"),
    "diagram_stats": (
        "diagram_id string, total_matches int, correct_count int, incorrect_count int, "
        "accuracy_pct decimal(5,2), avg_score decimal(6,2), last_updated timestamp"),
    # canonical precedents: union of the declared and the searched shapes
    "precedents": (
        "id string, created_at timestamp, case_number string, case_name string, court string, "
        "decision_date date, accident_type string, fault_ratio string, fault_a int, fault_b int, "
        "categories string, keywords array<string>, legal_basis array<string>, key_facts array<string>, "
        "summary string, raw_text string, confidence int, verified boolean, source string, "
        "relevance_score double"),
    "llm_usage": (
        "id string, created_at timestamp, model string, input_tokens int, output_tokens int, "
        "cost_usd decimal(8,6), purpose string, session_id string"),
    # implied tables
    "analysis_feedback": (
        "session_id string, accident_type string, knia_diagram string, predicted_fault_a int, "
        "predicted_fault_b int, actual_fault_a int, actual_fault_b int, is_correct boolean, "
        "user_comment string, modifiers_applied array<string>"),
    "diagram_accuracy": (
        "knia_diagram string, total_count bigint, correct_count bigint, accuracy_rate double, "
        "updated_at timestamp"),
    "video_training_data": (
        "video_name string, video_date string, filming_way string, point_of_view int, rate_a int, "
        "rate_b int, accident_object int, accident_place int, place_feature int, vehicle_a_info int, "
        "vehicle_b_info int, accident_type int, damage_location string, related_laws string, "
        "violation_of_law string, additional_elements string, violation_factor string, weather string, "
        "has_mp4 boolean, raw_json variant"),
    "motorcycle_hazard_data": "category string, label string, weather string, road_type string, is_defect string",
    "autonomous_fault_data": "fault_category string, fault_type string, sensor_name string, vehicle_type string",
    "aihub_categories": "tier string, code string",
    "precedent_cases": (
        "case_number string, court string, date date, accident_type string, fault_ratio_a int, "
        "fault_ratio_b int, key_reasoning string"),
    "violation_stats": "violation_type string, sub_type string, cnt bigint",
    "llm_analyses": (
        "id string, analysis_id string, session_id string, llm_diagram_id string, llm_fault_a int, "
        "llm_fault_b int, llm_confidence int, llm_reasoning string, llm_analysis string, "
        "llm_modifiers array<string>, llm_tokens int, matches_engine boolean"),
    # model reply object (response format of the analysis prompt)
    "llm_reply": (
        "step1_category string, step1_subcategory string, step1_keywords string, step1_id_range string, "
        "diagram_id string, diagram_title string, category string, confidence int, reasoning string, "
        "fault_a int, fault_b int, base_fault_a int, base_fault_b int, label_a string, label_b string, "
        f"detected_modifiers array<string>, modifier_detail array<{MODIFIER_DETAIL}>, "
        "legal_basis array<string>, precedent_refs array<string>, analysis string"),
}


def schema(name: str) -> StructType:
    """The StructType of a domain table (needs an active Spark session)."""
    return StructType.fromDDL(DDL[name])


def empty(spark, name: str):
    """An empty DataFrame with the table's schema (for wiring and tests)."""
    return spark.createDataFrame([], schema(name))

"""Typed schemas of the engine's entities, and a check that a frame has exactly the columns of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_SS = T.ArrayType(_S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2 and f[2]) for f in fields])


PARSED_BLOCK = _struct(("page_number", _I), ("section_path", _SS), ("source_start", _I), ("source_end", _I), ("text", _S))
PARSED_DOCUMENT = _struct(("pdf_sha256", _S), ("source_text_sha256", _S), ("clean_text", _S), ("page_count", _I), ("parse_status", _S), ("warnings", _SS), ("blocks", T.ArrayType(PARSED_BLOCK)))
CHUNK = _struct(("chunk_id", _S), ("document_id", _S), ("version_id", _S), ("text", _S), ("section_path", _S), ("page_start", _I), ("page_end", _I), ("parent_chunk_id", _S, True), ("previous_chunk_id", _S, True), ("next_chunk_id", _S, True), ("tenant_id", _S), ("visibility", _S), ("library_scope_ids", _SS), ("parse_version", _S), ("embedding_version", _S), ("is_active", _B))
SCOPE = _struct(("user_id", _S), ("tenant_id", _S), ("library_ids", _SS), ("folder_ids", _SS), ("document_ids", _SS), ("include_public", _B), ("acl_version", _S))
CANDIDATE = _struct(("rank", _I), ("chunk_id", _S), ("document_id", _S), ("score", _D, True))
RANKING_RESULT = _struct(("run_id", _S), ("dataset_version", _S), ("question_id", _S), ("backend", _S), ("top_k", _I), ("decision", _S), ("latency_ms", _D), ("candidates", T.ArrayType(CANDIDATE)))
JUDGMENT = _struct(("chunk_id", _S), ("document_id", _S), ("page_start", _I), ("page_end", _I), ("relevance", _I), ("supports_claims", _SS))
REFERENCE_CLAIM = _struct(("claim_id", _S), ("text", _S), ("required", _B))
FILTERS = _struct(("document_ids", _SS), ("year_gte", _I, True), ("year_lte", _I, True))
TURN = _struct(("role", _S), ("content", _S))
EVALUATION_ITEM = _struct(
    ("schema_version", _S), ("dataset_version", _S), ("question_id", _S), ("split", _S), ("leakage_group_id", _S), ("question", _S), ("conversation_history", T.ArrayType(TURN)), ("authorized_scope_ids", _SS), ("question_types", _SS), ("acceptable_answer_points", _SS), ("must_not_claim", _SS), ("expected_citations", _SS), ("annotation_record_ids", _SS), ("language", _S), ("query_form", _S),
    ("expected_route", _S), ("expected_filters", FILTERS), ("answerability", _S), ("chunk_judgments", T.ArrayType(JUDGMENT)), ("reference_claims", T.ArrayType(REFERENCE_CLAIM)), ("freshness_cutoff", _S, True), ("difficulty", _S), ("annotation_status", _S), ("final_annotation_id", _S, True), ("agreement_score", _D, True), ("blind_holdout", _B),
)
ANNOTATION = _struct(("annotation_id", _S), ("dataset_version", _S), ("question_id", _S), ("role", _S), ("annotator_id", _S), ("actor_type", _S), ("model_identity", _S, True), ("prompt_version", _S, True), ("temperature", _D, True), ("submitted_at", _TS), ("answerability", _S), ("expected_route", _S), ("notes", _S), ("chunk_judgments", T.ArrayType(JUDGMENT)), ("based_on_annotation_ids", _SS))
EVIDENCE = _struct(("evidence_id", _S), ("chunk_id", _S), ("document_id", _S), ("version_id", _S), ("page_start", _I), ("page_end", _I), ("quote", _S))
CITATION = _struct(("citation_id", _S), ("evidence_id", _S), ("position", _I))
ANSWER = _struct(("request_id", _S), ("status", _S), ("answer", _S), ("evidence", T.ArrayType(EVIDENCE)), ("citations", T.ArrayType(CITATION)), ("warnings", _SS))
CLAIM = _struct(("claim_id", _S), ("text", _S), ("citation_ids", T.ArrayType(_I)))
DOCUMENT_IDENTITY = _struct(("owner_id", _S), ("document_id", _S), ("paper_id", _S), ("source_type", _S), ("mapping_version", _S), ("source_created_time", _TS), ("source_updated_time", _TS))
VERSION_LIFECYCLE = _struct(("owner_id", _S), ("document_id", _S), ("document_version_id", _S), ("content_sha256", _S), ("lifecycle_status", _S), ("revision", _L), ("elasticsearch_state", _S), ("milvus_state", _S), ("parsed_at", _TS, True), ("embedded_at", _TS, True), ("indexed_at", _TS, True), ("verified_at", _TS, True), ("ready_at", _TS, True), ("deleted_at", _TS, True), ("expired_at", _TS, True), ("failure_code", _S, True))
CLEANUP_JOB = _struct(("job_id", _S), ("backend", _S), ("owner_id", _S), ("document_id", _S), ("document_version_id", _S), ("status", _S), ("attempt_count", _I), ("max_attempts", _I), ("next_attempt_at", _TS), ("lease_token", _S, True), ("lease_expires_at", _TS, True), ("failure_code", _S, True), ("completed_at", _TS, True))


def schema_violations(df: DataFrame, schema: T.StructType) -> list[str]:
    """Missing and extra columns and other types, one line each; nothing is inferred and unknown fields are refused."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    plain = lambda t: t.simpleString()
    return [f"missing {c}" for c in want if c not in have] + [f"extra {c}" for c in have if c not in want] + [f"type of {c}" for c in want if c in have and plain(want[c]) != plain(have[c])]


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    if found := schema_violations(df, schema):
        raise ValueError("; ".join(found))
    return df

"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

#: Every kind of chunk metadata in one nullable struct.
METADATA = (
    "struct<page_number:int,page_count:int,start_char:int,end_char:int,heading:string,heading_level:int,"
    "heading_path:array<string>,section_part:int,start_char_in_section:int,end_char_in_section:int,"
    "start_paragraph:int,end_paragraph:int,similarity_threshold:double>"
)
_REGISTRY_ROW = (
    "struct<document_id:string,filename:string,file_type:string,chunk_count:int,ingested_at:string,"
    "chunking_strategy:string>"
)
_DDL = {
    "DOCUMENT": "text string, source string, file_type string, metadata struct<page_number:int,page_count:int>",
    "CHUNK": (
        "chunk_id string, text string, source string, file_type string, chunk_index int, chunking_strategy string, "
        f"metadata {METADATA}"
    ),
    "REGISTRY_ROW": (
        "document_id string, filename string, file_type string, chunk_count int, ingested_at string, "
        "chunking_strategy string"
    ),
    "REGISTRY_FILE": f"documents array<{_REGISTRY_ROW}>",
    "RETRIEVAL_CASE": "id int, category string, question string, expected_chunk_ids array<string>",
    "GOLDEN_CASE": (
        "id string, primary_category string, tags array<string>, difficulty string, question string, "
        "answerable boolean, answerability_type string, reference_answer string, "
        "required_facts array<struct<id:string,description:string,required:boolean,supported_by:array<string>>>, "
        "expected_sources array<struct<document:string,section:string>>, "
        "evidence_spans array<struct<id:string,document:string,section:string,text:string>>, "
        "acceptable_answer_paths array<string>, evaluation_method string, notes string"
    ),
    "CASE_RESULT": (
        "case_id string, primary_category string, difficulty string, expected_answerable boolean, decision string, "
        "should_abstain boolean, candidate_source_recall double, candidate_evidence_recall double, "
        "candidate_hit boolean, candidate_mrr double, final_source_recall double, final_evidence_recall double, "
        "final_hit boolean, final_mrr double, completeness_score double, covered_facts int, "
        "total_required_facts int, correctness_score double, correct_claims int, partially_correct_claims int, "
        "incorrect_claims int, correctness_results array<struct<claim:string,verdict:string,explanation:string>>, "
        "fact_results array<struct<fact:string,matched:boolean,lexical_score:double,semantic_score:double,"
        "matched_by:string>>, faithfulness_score double, citation_precision double, citation_coverage double, "
        "total_latency_ms double, verification_latency_ms double"
    ),
    "BEIR_DOC": "_id string, title string, text string",
    "BEIR_QUERY": "_id string, text string",
}


@cache
def of(name: str) -> StructType:
    """The schema of a table; it needs a session, so it is made when first asked for."""
    return StructType.fromDDL(_DDL[name])

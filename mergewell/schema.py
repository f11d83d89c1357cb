"""The record that all sources map to; merged records share it.

Open objects (experience, education, projects, payloads) are JSON texts with sorted keys, so
that they can be keys of joins and groups, which VARIANT cannot.
"""

from __future__ import annotations

SCALARS = ("external_id", "full_name", "location", "headline", "resume_summary", "resume_file")
STRING_LISTS = ("emails", "phones", "links", "skills", "certifications")
OBJECT_LISTS = ("experience", "education", "projects")
SOURCE = "struct<source_type:string,source_name:string,source_record_id:string,source_uri:string,ingested_at:timestamp>"
RAW_VALUES = "array<struct<field_name:string,source_key:string,value:string>>"
TYPES = (
    {"record_idx": "bigint", "source": SOURCE}
    | dict.fromkeys(SCALARS, "string")
    | {"years_experience": "double"}
    | dict.fromkeys(STRING_LISTS, "array<string>")
    | dict.fromkeys(OBJECT_LISTS, "array<string>")
    | {"raw_values": RAW_VALUES, "raw_payload": "string"}
)
#: Fields that carry confidence and provenance, with their weights in the overall score (fixed values).
FIELD_WEIGHTS = {
    "external_id": 0.8,
    "full_name": 1.0,
    "emails": 1.0,
    "phones": 0.9,
    "location": 0.5,
    "links": 0.8,
    "headline": 0.4,
    "years_experience": 0.5,
    "skills": 0.7,
    "experience": 0.8,
    "education": 0.6,
    "projects": 0.5,
    "certifications": 0.4,
    "resume_summary": 0.3,
}

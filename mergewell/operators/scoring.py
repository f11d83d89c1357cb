"""Confidence of fields and records, and where each value came from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.schema import FIELD_WEIGHTS

# How far a source is trusted, and which raw fields speak for which field.
SOURCE_WEIGHTS = {
    "linkedin": 0.9,
    "linkedin_profile": 0.9,
    "github": 0.8,
    "github_profile": 0.8,
    "json": 0.7,
    "ats_json": 0.7,
    "resume": 0.7,
    "csv": 0.6,
    "recruiter_csv": 0.6,
    "manual": 0.5,
    "other": 0.4,
    "merge_engine": 0.4,
}
DEFAULT_WEIGHT = 0.4
RAW_ALIASES = {
    "name": "full_name",
    "username": "external_id",
    "candidate_id": "external_id",
    "profile_url": "links",
    "github_url": "links",
    "linkedin_url": "links",
    "bio": "headline",
    "languages": "skills",
    "repositories": "experience",
    "companies": "experience",
    "job_titles": "experience",
    "duration": "experience",
    "degree": "education",
    "college": "education",
    "graduation_year": "education",
    "project_names": "projects",
}


def _map(table: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def has_value(field: str, dtypes: Mapping[str, str]) -> Column:
    c = F.col(field)
    if dtypes[field].startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() & ((c != "") if dtypes[field] == "string" else F.lit(True))


def _speakers(records: DataFrame) -> DataFrame:
    """Add ``_raw``, the raw values as struct(field, source, source_key), and ``_merged``, the labels of what was merged; each once."""
    own = F.coalesce("source.source_name", "source.source_type")
    key = lambda x: x["source_key"]
    one = lambda x: F.struct(
        F.coalesce(F.element_at(_map(RAW_ALIASES), x["field_name"]), x["field_name"]).alias("field"),
        F.when(key(x).contains(":"), F.split_part(key(x), F.lit(":"), F.lit(1))).otherwise(own).alias("source"),
        F.when(key(x).contains(":"), F.regexp_replace(key(x), "^[^:]*:", "")).otherwise(key(x)).alias("source_key"),
    )
    merged = F.array_sort(F.array_distinct(F.transform("merged_from", lambda x: x["label"]))) if "merged_from" in records.columns else F.array().cast("array<string>")
    return records.withColumn("_raw", F.transform("raw_values", one)).withColumn("_merged", merged)


def evidence(field: Column) -> Column:
    """Who speaks for a field of :func:`_speakers`: its raw values, else all that was merged, else the record's own source."""
    own = F.array(F.coalesce("source.source_name", "source.source_type"))
    speaking = F.array_sort(F.array_distinct(F.transform(F.filter("_raw", lambda x: x["field"] == field), lambda x: x["source"])))
    return S.let(speaking, lambda v: F.when(F.size(v) > 0, v).when(F.size("_merged") > 0, F.col("_merged")).otherwise(own))


def noisy_or(labels: Column, weights: Mapping[str, float] = SOURCE_WEIGHTS, default: float = DEFAULT_WEIGHT) -> Column:
    """1 less the chance that all sources are wrong, to four places."""
    weight = lambda x: S.clamp01(F.coalesce(F.element_at(_map(weights), x), F.lit(default)))
    return F.aggregate(labels, F.lit(1.0), lambda acc, x: acc * (1 - weight(x)), lambda acc: F.round(1 - acc, 4))


def score(records: DataFrame, source_weights: Mapping[str, float] = SOURCE_WEIGHTS, field_weights: Mapping[str, float] = FIELD_WEIGHTS, default: float = DEFAULT_WEIGHT) -> DataFrame:
    """Add ``field_confidence`` (map) and ``overall_confidence``; empty fields score 0 and are not weighed."""
    kinds = dict(records.dtypes)
    fields = F.array(*[F.struct(F.lit(f).alias("name"), has_value(f, kinds).alias("there")) for f in field_weights])
    each = F.transform(fields, lambda f: F.when(f["there"], noisy_or(evidence(f["name"]), source_weights, default)).otherwise(F.lit(0.0)))
    out = _speakers(records).withColumn("_scores", each).drop("_raw", "_merged")
    names, weights = (F.array(*[F.lit(x) for x in v]) for v in (field_weights, field_weights.values()))
    total = F.aggregate(F.zip_with("_scores", weights, lambda c, w: F.when(c != 0, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, w: acc + w)
    gain = F.aggregate(F.zip_with("_scores", weights, lambda c, w: c * w), F.lit(0.0), lambda acc, x: acc + x)
    out = out.withColumn("overall_confidence", F.when(total > 0, F.round(gain / total, 4)).otherwise(F.lit(0.0)))
    return out.withColumn("field_confidence", F.map_from_arrays(names, F.col("_scores"))).drop("_scores")


# How a field's value came about.
MERGE_METHODS = {f: "source_priority" for f in ("external_id", "full_name", "location", "headline", "years_experience", "resume_summary")}
MERGE_METHODS |= {f: "union_deduplicate" for f in ("emails", "phones", "links", "skills", "experience", "education", "projects", "certifications")}


def provenance(records: DataFrame, merge_methods: Mapping[str, str] | None = None, timestamps: bool = True) -> DataFrame:
    """Add ``provenance``: array of (field, source, source_key, confidence, merge_method, observed), a row for each distinct
    speaking raw value of a field, else one for the record itself; fields in their fixed order, empty fields that no raw value names have none.

    ``merge_methods`` override the names of methods; without ``timestamps`` ``observed`` is null.
    """
    kinds, own = dict(records.dtypes), F.coalesce("source.source_name", "source.source_type")
    methods = _map(MERGE_METHODS | dict(merge_methods or {}))
    at = F.col("source.ingested_at")
    df = _speakers(records).withColumn("_said", F.array_distinct("_raw"))
    if "merged_from" in records.columns:
        df = df.withColumn("_times", F.transform("merged_from", lambda m: F.struct(F.array(m["source"]["source_type"], m["source"]["source_name"]).alias("names"), m["source"]["ingested_at"].alias("at"))))
        observed = lambda x: F.when(x["source_key"].isNull(), at).otherwise(F.coalesce(F.get(F.filter("_times", lambda t: F.array_contains(t["names"], x["source"])), 0)["at"], at))
    else:
        observed = lambda x: at
    seen = observed if timestamps else (lambda x: F.lit(None).cast("timestamp"))
    fields = F.array(*[F.struct(F.lit(f).alias("name"), has_value(f, kinds).alias("there")) for f in FIELD_WEIGHTS])
    none = F.lit(None).cast("string")

    def entries(f: Column) -> Column:
        alone = F.when(f["there"], F.array(F.struct(f["name"].alias("field"), own.alias("source"), none.alias("source_key")))).otherwise(F.filter("_said", lambda _: F.lit(False)))
        return S.let(F.filter("_said", lambda x: x["field"] == f["name"]), lambda v: F.when(F.size(v) > 0, v).otherwise(alone))

    df = df.withColumn("_all", F.flatten(F.transform(fields, entries)))
    one = lambda x: F.struct(x["field"].alias("field"), x["source"].alias("source"), x["source_key"].alias("source_key"), F.element_at("field_confidence", x["field"]).alias("confidence"), F.element_at(methods, x["field"]).alias("merge_method"), seen(x).alias("observed"))
    return df.withColumn("provenance", F.transform("_all", one)).drop("_raw", "_merged", "_said", "_times", "_all")


def provenance_rows(records: DataFrame, **options) -> DataFrame:
    """The same as rows (cluster_id, field, source, source_key, confidence, merge_method, observed)."""
    return provenance(records, **options).select("cluster_id", F.explode("provenance").alias("p")).select("cluster_id", "p.*")

"""Delimited scan: every cell is text, columns map to fields by configurable names."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.sources.records import SourceError, as_records, checked, source


@dataclass(frozen=True)
class ColumnMapping:
    """Header of each field; several headers may feed one field, the first non-empty cell wins.  The defaults are fixed values."""

    external_id: str = "candidate_id"
    full_name: str = "full_name"
    name: str = "name"
    emails: str = "emails"
    email: str = "email"
    phones: str = "phones"
    phone: str = "phone"
    location: str = "location"
    links: str = "links"
    github_url: str = "github_url"
    headline: str = "headline"
    title: str = "title"
    years_experience: str = "years_experience"
    skills: str = "skills"
    experience: str = "experience"
    education: str = "education"
    current_company: str = "current_company"
    current_title: str = "current_title"
    total_experience: str = "total_experience"
    current_location: str = "current_location"
    recruiter_notes: str = "recruiter_notes"
    resume_file: str = "resume_file"


IDENTIFYING = ("external_id", "full_name", "name", "emails", "email", "phones", "phone", "links", "github_url")


def read(spark: SparkSession, path: str, mapping: ColumnMapping | None = None, list_delimiter: str = ",", source_name: str = "recruiter_csv", ingested_at: str = "1970-01-01 00:00:00", multi_line: bool = True) -> DataFrame:
    """Records with ``error`` (null for good rows) from a file with a header.

    Without ``multi_line`` no cell may hold a line break, and a large file is read by many tasks.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False, nullValue="\u0000")
    numbered = df.withColumn("record_idx", F.monotonically_increasing_id())
    return from_frame(numbered, mapping, list_delimiter, source_name, F.input_file_name(), ingested_at)


def from_frame(df: DataFrame, mapping: ColumnMapping | None = None, list_delimiter: str = ",", source_name: str = "recruiter_csv", uri: Column | None = None, ingested_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """The same from a frame of text columns with ``record_idx``."""
    m = asdict(mapping or ColumnMapping())
    if not any(m[f] in df.columns for f in IDENTIFYING):
        raise SourceError("no identifying column among " + ", ".join(df.columns))
    cell = lambda f: F.nullif(F.col(f"`{m[f]}`"), F.lit("")) if m[f] in df.columns else F.lit(None).cast("string")
    first = lambda *fs: F.coalesce(*[cell(f) for f in fs])
    items = lambda f: F.filter(F.split(F.coalesce(cell(f), F.lit("")), f"\\Q{list_delimiter}\\E"), lambda x: x != "")
    filled = lambda *fs: F.filter(F.concat(*[items(f) for f in fs]), lambda x: ~x.rlike(r"^\s*$"))
    raw_entry = lambda f: F.when(cell(f).isNotNull(), F.array(F.to_json(F.struct(cell(f).alias("raw"))))).otherwise(F.array().cast("array<string>"))
    years = first("years_experience", "total_experience")
    number = F.when(years.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), years.try_cast("double"))
    job = F.to_json(F.struct(cell("current_company").alias("company"), first("title", "current_title").alias("title")))
    experience = F.when(cell("experience").isNotNull(), raw_entry("experience")).when(first("current_company", "title", "current_title").isNotNull(), F.array(job)).otherwise(F.array().cast("array<string>"))
    cells = [F.struct(F.lit(f.name).alias("field_name"), F.lit(m[f.name]).alias("source_key"), cell(f.name).alias("value")) for f in fields(ColumnMapping) if m[f.name] in df.columns]
    given = [c for c in df.columns if c != "record_idx"]
    df = df.withColumn("error", F.when(years.isNotNull() & number.isNull(), "years_experience is not a number"))
    out = as_records(
        df,
        record_idx=F.col("record_idx"),
        source=source("csv", source_name, cell("external_id"), F.lit(None).cast("string") if uri is None else uri, ingested_at),
        external_id=cell("external_id"),
        full_name=first("full_name", "name"),
        location=first("location", "current_location"),
        headline=first("headline", "title", "current_title"),
        resume_file=cell("resume_file"),
        years_experience=number,
        emails=filled("emails", "email"),
        phones=filled("phones", "phone"),
        links=filled("links", "github_url"),
        skills=items("skills"),
        experience=experience,
        education=raw_entry("education"),
        raw_values=F.filter(F.array(*cells), lambda x: x["value"].isNotNull()),
        raw_payload=F.to_json(F.struct(*[F.col(f"`{c}`") for c in given])),
    )
    return checked(out)

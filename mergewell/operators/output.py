"""Canonical candidates, their configurable projection, its validation, reports and dashboard queries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S

STRATEGIES = ("keep_null", "omit", "empty_string")
FIELDS = ("candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "projects", "certifications", "resume_summary", "overall_confidence", "field_confidence", "provenance")


class ConfigError(ValueError):
    """A configuration that names what there is not."""


@dataclass(frozen=True)
class OutputField:
    name: str
    required: bool = False


@dataclass(frozen=True)
class Config:
    """Which fields come out, under which names, and what stands for a missing value."""

    output_fields: tuple[OutputField, ...]
    field_renaming: dict[str, str] = field(default_factory=dict)
    missing_value_strategy: str = "keep_null"
    source_priorities: dict[str, int] = field(default_factory=dict)
    apply_normalization: bool = False
    use_ai: bool = False

    def __post_init__(self):
        names = [f.name for f in self.output_fields]
        if not names or any(not n.strip() for n in names):
            raise ConfigError("output_fields needs names")
        if self.missing_value_strategy not in STRATEGIES:
            raise ConfigError(f"unknown strategy {self.missing_value_strategy}")
        if set(self.field_renaming) - set(names):
            raise ConfigError("field_renaming names a field that is not put out")
        if any(v < 0 for v in self.source_priorities.values()):
            raise ConfigError("priorities start at 0")

    @classmethod
    def of(cls, given: Config | dict | str | Path) -> Config:
        """From a config, a dict, or the path of a JSON file."""
        if isinstance(given, cls):
            return given
        if not isinstance(given, dict):
            try:
                given = json.loads(Path(given).read_text())
            except (OSError, ValueError) as e:
                raise ConfigError(str(e)) from e
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ConfigError(f"unknown keys {sorted(unknown)}")
        fields = tuple(OutputField(**f) if isinstance(f, dict) else f for f in given.get("output_fields", ()))
        return cls(**{**given, "output_fields": fields})


def _text(x: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in keys])


def _technologies(x: Column) -> Column:
    """A project's technologies as texts; a single one is a list of one, blanks go."""
    v = F.try_variant_get(F.try_parse_json(x), "$.technologies", "variant")
    many = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
    return F.filter(many, lambda t: t.isNotNull() & (t != ""))


def canonical(merged: DataFrame, merge_methods: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns of scored, merged records, with ``errors``: what a strict reader would refuse."""
    from mergewell.operators import scoring

    link = lambda x: F.struct(F.coalesce(S.link(x)["category"], F.lit("other")).alias("type"), x.alias("url"))
    entries = lambda c, needs, build: F.transform(F.filter(c, lambda x: _text(x, *needs).isNotNull()), build)
    company, school, project = ("company", "employer", "organization"), ("institution", "school", "university"), ("name", "project", "title")
    confidence = F.element_at("field_confidence", F.lit("skills"))
    out = scoring.provenance(merged, merge_methods).select(
        "cluster_id", "record_idx",
        F.coalesce(F.nullif("external_id", F.lit("")), F.get("emails", 0), F.nullif("full_name", F.lit("")), F.lit("unknown")).alias("candidate_id"),
        F.coalesce(F.nullif("full_name", F.lit("")), F.lit("Unknown Candidate")).alias("full_name"),
        "emails", "phones",
        F.when(F.col("location").isNotNull(), F.struct(F.col("location").alias("raw"))).alias("location"),
        F.transform("links", link).alias("links"),
        "headline", "years_experience",
        F.transform("skills", lambda x: F.struct(x.alias("name"), confidence.alias("confidence"))).alias("skills"),
        entries("experience", company, lambda x: F.struct(_text(x, *company).alias("company"), _text(x, "title").alias("title"))).alias("experience"),
        entries("education", school, lambda x: F.struct(_text(x, *school).alias("institution"), _text(x, "degree").alias("degree"), _text(x, "field_of_study").alias("field_of_study"))).alias("education"),
        entries("projects", project, lambda x: F.struct(_text(x, *project).alias("name"), _text(x, "description", "raw").alias("description"), _technologies(x).alias("technologies"))).alias("projects"),
        "certifications", "resume_summary",
        F.transform("provenance", lambda p: F.struct(S.source_type(p["source"]).alias("source"), p["field"].alias("field"), p["confidence"].alias("confidence"))).alias("provenance"),
        "overall_confidence", "field_confidence", "merged_from",
    )
    checks = {
        "link without http": F.exists("links", lambda x: ~x["url"].rlike("^https?://")),
        "malformed e-mail": F.exists("emails", lambda x: ~x.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")),
        "blank list item": F.exists(F.concat("emails", "phones", "certifications"), lambda x: x.rlike(r"^\s*$")) | F.exists("skills", lambda x: x["name"].rlike(r"^\s*$")),
        "years_experience below 0": F.col("years_experience") < 0,
        "confidence outside 0 to 1": (F.col("overall_confidence") < 0) | (F.col("overall_confidence") > 1),
    }
    return out.withColumn("errors", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull()))


def _json(c: Column, kind: str) -> Column:
    """JSON of a value, nested nulls included; SQL null stays null."""
    if kind == "string":
        return S.json_text(c)
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return F.when(F.isnan(c.cast("double")), F.lit(None)).otherwise(c.cast("string")) if kind == "double" else c.cast("string")


def project(candidates: DataFrame, config: Config | dict | str) -> DataFrame:
    """(cluster_id, output, present): a JSON object of the configured fields in order, and the names in it."""
    config, kinds = Config.of(config), dict(candidates.dtypes)
    parts, names = [], []
    for f in config.output_fields:
        if f.name not in candidates.columns:
            raise ConfigError(f"no field {f.name}")
        c, kind = F.col(f.name), kinds[f.name]
        if config.apply_normalization:
            if f.name == "emails":
                c = F.filter(F.transform(c, lambda x: S.email(x)), lambda x: x.isNotNull())
            elif f.name == "phones":
                c = F.filter(F.transform(c, lambda x: S.phone(x)), lambda x: x.isNotNull())
            elif f.name == "skills":
                c, kind = S.skills(F.transform(c, lambda x: x["name"])), "array<string>"
        missing = c.isNull() | ((F.size(c) == 0) if kind.startswith(("array", "map")) else F.lit(False))
        name = config.field_renaming.get(f.name, f.name)
        instead = {"keep_null": F.lit("null"), "omit": F.lit(None).cast("string"), "empty_string": F.lit('""')}[config.missing_value_strategy]
        value = F.when(missing, F.lit("null") if config.missing_value_strategy == "keep_null" else instead).otherwise(_json(c, kind))
        parts.append(F.concat(F.lit(json.dumps(name) + ":"), value))
        names.append(F.when(value.isNotNull(), F.lit(name)))
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return candidates.select("cluster_id", body.alias("output"), F.filter(F.array(*names), lambda x: x.isNotNull()).alias("present"))


def validate(projected: DataFrame, config: Config | dict | str) -> DataFrame:
    """Add ``validation``: array of (field, message, error_type), empty for good output; never fails."""
    config = Config.of(config)
    expected = [config.field_renaming.get(f.name, f.name) for f in config.output_fields]
    v = F.try_parse_json("output")
    keys = F.json_object_keys("output")
    error = lambda name, message, kind: F.struct(name.alias("field"), F.lit(message).alias("message"), F.lit(kind).alias("error_type"))
    wanted = F.array(*[F.lit(e) for e in expected])
    missing = F.transform(F.array_except(wanted, keys), lambda k: error(k, "field is missing", "missing"))
    extra = F.transform(F.array_except(keys, wanted), lambda k: error(k, "field is not expected", "extra_forbidden"))
    needed = []
    for f in config.output_fields:
        if f.required:
            name = config.field_renaming.get(f.name, f.name)
            text = F.get_json_object("output", f"$['{name}']")
            needed.append(F.when(text.isNull() | text.isin("", "[]", "{}"), error(F.lit(name), "a required field has no value", "required_missing")))
    needed = F.filter(F.array(*needed), lambda x: x.isNotNull()) if needed else F.filter(F.array(error(F.lit(""), "", "")), lambda _: F.lit(False))
    good = F.concat(missing, extra, needed)
    root = F.array(error(F.lit("$"), "output is not an object", "invalid_root_type"))
    # what is no JSON at all cannot be written; null is JSON of another type
    broken = F.array(error(F.lit("$"), "output cannot be written as JSON", "not_json_serializable"))
    return projected.withColumn("validation", F.when(F.col("output").isNotNull() & v.isNull(), broken).when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), root).otherwise(good))


def error_count(validated: DataFrame) -> DataFrame:
    """(errors): all validation errors of a run."""
    return validated.agg(F.coalesce(F.sum(F.size("validation")), F.lit(0)).cast("long").alias("errors"))


def merge_report(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(records_read, canonical_records, duplicates, reduction)."""
    both = records.select("record_idx").join(clusters, "record_idx", "left").agg(F.count(F.lit(1)).alias("records_read"), F.count_distinct("cluster_id").alias("canonical_records"))
    both = both.withColumn("duplicates", F.greatest(F.col("records_read") - F.col("canonical_records"), F.lit(0)))
    return both.withColumn("reduction", F.when(F.col("records_read") > 0, F.round(F.col("duplicates") / F.col("records_read"), 4)).otherwise(F.lit(0.0)))


def contributing(merged: DataFrame) -> DataFrame:
    """(cluster_id, sources): distinct source labels in rank order."""
    return merged.select("cluster_id", S.dedup_ci(F.transform("merged_from", lambda x: x["label"])).alias("sources"))


def resume_matches(candidates: DataFrame, resumes: DataFrame, names: bool = True) -> DataFrame:
    """(resume_idx, record_idx, rule): each résumé's first hit by file name, e-mail, phone, then nearest name from 90 on (unless ``names`` is off).

    The least rule wins, then the earliest candidate (for names the best score first).
    """
    from mergewell.functions import similarity

    def keys(df: DataFrame, idx: str) -> DataFrame:
        rules = [F.transform(F.filter(F.array(S.file_key(F.col("resume_file"))), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(1).alias("rule"), x.alias("key")))]
        rules += [F.transform("emails", lambda x: F.struct(F.lit(2).alias("rule"), S.fold(S.strip_ws(x)).alias("key"))), F.transform("phones", lambda x: F.struct(F.lit(3).alias("rule"), S.phone_key(x).alias("key")))]
        return df.select(F.col("record_idx").alias(idx), F.explode(F.concat(*rules)).alias("k")).select(idx, "k.rule", "k.key").where("key is not null")

    first = keys(candidates, "record_idx").groupBy("rule", "key").agg(F.min("record_idx").alias("record_idx"))
    hits = keys(resumes, "resume_idx").join(first, ["rule", "key"]).select("resume_idx", "rule", "record_idx", F.lit(0.0).alias("score"))
    if not names:
        best = hits.groupBy("resume_idx").agg(F.min(F.struct("rule", "record_idx")).alias("m"))
        return best.select("resume_idx", F.col("m.record_idx").alias("record_idx"), F.col("m.rule").alias("rule"))
    distinct = lambda df, name: df.where("full_name is not null").select(F.col("full_name").alias(name)).distinct()
    named = lambda df, idx, name: df.select(F.col("record_idx").alias(idx), F.col("full_name").alias(name))
    near = similarity.near_pairs(distinct(resumes, "l"), distinct(candidates, "r"), 90.0)
    near = near.withColumn("score", similarity.token_set_ratio(F.col("l"), F.col("r"))).where("score >= 90")
    fuzzy = near.join(named(resumes, "resume_idx", "l"), "l").join(named(candidates, "record_idx", "r"), "r").select("resume_idx", F.lit(4).alias("rule"), "record_idx", "score")
    best = hits.union(fuzzy).groupBy("resume_idx").agg(F.min(F.struct("rule", -F.col("score"), "record_idx")).alias("m"))
    return best.select("resume_idx", F.col("m.record_idx").alias("record_idx"), F.col("m.rule").alias("rule"))


def fill_missing(records: DataFrame, given: DataFrame, scalars: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """Enrichment by ``record_idx``: scalars fill only what is missing, lists append what is new; ``status`` tells who had any."""
    names = {c: f"_{c}" for c in (*scalars, *lists)}
    joined = records.join(given.select("record_idx", *[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("_hit")), "record_idx", "left")
    cols = {c: F.coalesce(F.when((F.col(c).cast("string") != ""), F.col(c)), F.col(names[c])) for c in scalars}
    cols |= {c: S.dedup_ci(F.concat(F.coalesce(c, F.array()), F.coalesce(names[c], F.array()))) for c in lists}
    return joined.withColumns(cols).withColumn("status", F.when(F.col("_hit"), "enriched").otherwise("unavailable")).drop("_hit", *names.values())


# How sources are shown.
SOURCE_LABELS = {
    "recruiter_csv": "Recruiter CSV", "csv": "Recruiter CSV", "ats_json": "ATS JSON", "json": "ATS JSON",
    "github_api": "GitHub", "github_profile": "GitHub", "github": "GitHub", "resume": "Resume", "linkedin_profile": "LinkedIn", "linkedin": "LinkedIn",
}


def shown_sources(sources: Column) -> Column:
    """Source labels as they are shown, ordered and distinct; none gives Unknown."""
    names = F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])
    shown = S.dedup_ci(F.transform(sources, lambda x: F.coalesce(F.element_at(names, S.fold(x)), F.initcap(F.replace(x, F.lit("_"), F.lit(" "))))))
    return F.when(F.size(shown) > 0, shown).otherwise(F.array(F.lit("Unknown")))


def first_or_dash(items: Column) -> Column:
    return F.coalesce(F.get(items, 0), F.lit("-"))


def location_text(location: Column) -> Column:
    """A location's raw text, else its parts, else a dash; for structs with any of raw, city, region, country."""
    return F.coalesce(F.nullif(location["raw"], F.lit("")), F.lit("-"))


def percent(c: Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))


def details(candidates: DataFrame) -> DataFrame:
    """(cluster_id, section, position, label, value): what a candidate's page shows, a row a line."""
    row = lambda section, label, value: F.struct(F.lit(section).alias("section"), label.alias("label"), value.alias("value"))
    text = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))
    lists = {
        "experience": F.transform("experience", lambda e: row("experience", text(e["title"]), e["company"])),
        "education": F.transform("education", lambda e: row("education", text(e["degree"]), e["institution"])),
        "projects": F.transform("projects", lambda e: row("projects", e["name"], text(e["description"]))),
        "links": F.transform("links", lambda e: row("links", e["type"], e["url"])),
        "confidence": F.transform(F.map_entries("field_confidence"), lambda e: row("confidence", e["key"], percent(e["value"]))),
        "provenance": F.transform("provenance", lambda e: row("provenance", e["field"], F.concat(e["source"], F.lit(" "), percent(e["confidence"])))),
    }
    head = [("Name", F.col("full_name")), ("Headline", text(F.col("headline"))), ("Email", first_or_dash(F.col("emails"))), ("Phone", first_or_dash(F.col("phones"))), ("Location", F.coalesce(location_text(F.col("location")), F.lit("-"))), ("Overall", percent(F.col("overall_confidence")))]
    rows = F.concat(F.array(*[row("profile", F.lit(k), c) for k, c in head]), *lists.values())
    return candidates.select("cluster_id", F.posexplode(rows).alias("position", "r")).select("cluster_id", "r.section", "position", "r.label", "r.value")


def dashboard(candidates: DataFrame, name_contains: str = "", status: str | None = None, ascending: bool = False) -> DataFrame:
    """Summary rows by confidence: name, first e-mail, first company, percent, status; ties keep the output order."""
    rows = candidates.select(
        "cluster_id", "record_idx", F.col("full_name").alias("name"), F.get("emails", 0).alias("email"), F.get("experience", 0)["company"].alias("company"),
        F.round(F.col("overall_confidence") * 100, 1).alias("confidence_pct"), F.when(F.size("errors") == 0, "valid").otherwise("invalid").alias("status"),
    )
    if name_contains:
        rows = rows.where(S.fold(F.col("name")).contains(name_contains.casefold()))
    if status:
        rows = rows.where(F.col("status") == status)
    c = F.col("confidence_pct")
    return rows.orderBy(c.asc() if ascending else c.desc(), "record_idx").drop("record_idx")


def links_by_type(candidates: DataFrame) -> DataFrame:
    """(cluster_id, type, url): of each type the last link."""
    each = candidates.select("cluster_id", F.posexplode("links").alias("at", "l"))
    return each.groupBy("cluster_id", F.col("l.type").alias("type")).agg(F.max_by("l.url", "at").alias("url"))


def by_name(candidates: DataFrame) -> DataFrame:
    """(name, cluster_id): of equal names the last in output order."""
    return candidates.groupBy(F.col("full_name").alias("name")).agg(F.max_by("cluster_id", "record_idx").alias("cluster_id"))

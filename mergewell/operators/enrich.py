"""Optional stages before matching: profiles behind links, résumés, and what an outside model adds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.operators import extract, output
from mergewell.operators.clustering import checkpointed
from mergewell.sources import nested
from mergewell.sources.records import append, split_valid

#: Fields of a model's answer that are kept beside a record (fixed values).
INSIGHTS = ("strengths", "suggested_roles", "suggested_skills", "potential_missing_information", "field_confidences", "responsibilities", "achievements")
AI_SCALARS = ("external_id", "full_name", "location", "headline", "years_experience", "resume_summary", "resume_file")
AI_STRINGS = ("emails", "phones", "links", "skills", "certifications")
AI_OBJECTS = ("experience", "education", "projects")
AI_LISTS = (*AI_STRINGS, *AI_OBJECTS)


def profile_urls(records: DataFrame) -> DataFrame:
    """(record_idx, url): the distinct code-host links of all records, each with the first record that has it."""
    links = records.select("record_idx", F.posexplode("links").alias("at", "link")).select("record_idx", "at", S.link(F.col("link")).alias("l"))
    known = links.where("l.category = 'github'").select("record_idx", "at", F.col("l.url").alias("url"), S.fold(F.regexp_replace("l.url", "/+$", "")).alias("key"))
    return known.groupBy("key").agg(F.min(F.struct("record_idx", "at", "url")).alias("m")).select("m.record_idx", "m.at", "m.url")


def enrich_profiles(records: DataFrame, profiles_table: DataFrame | None = None, fetch: Callable | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(records, warnings): the records and behind them one for each profile that their links lead to.

    Profiles come from a table (login, v, repos) or, once a distinct login, from a client's ``fetch``.
    New records are numbered in order of the records and links that named them.  Links without a profile give a warning (url, warning).
    """
    urls = profile_urls(records)
    numbered = urls.repartitionByRange("record_idx", "at").sortWithinPartitions("record_idx", "at").withColumn("record_idx", F.monotonically_increasing_id()).drop("at")
    found, warnings = nested.code_profiles(numbered, profiles_table, **options) if fetch is None else nested.fetch_profiles(numbered, fetch, **options)
    good, bad = split_valid(found)
    warnings = warnings.select("url", "warning").union(bad.select(F.col("source.source_uri"), "error"))
    return append(records, good), warnings


def add_resumes(records: DataFrame, documents: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(records, failures): the records and behind them one for each résumé of (record_idx, path, text[, error]).

    A résumé that matches a record says so in its payload (``matched_candidate``).  One that cannot be read is a row of
    failures (resume_file, candidate, reason), with the name of the first record that names its file, if any.
    """
    # written once: matching, annotating and numbering all read them, and their plans would repeat the extraction each time
    good, bad = split_valid(checkpointed(extract.resumes(documents, **options)))
    hits = checkpointed(output.resume_matches(records, good))
    who = records.select("record_idx", F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit(None)).alias(c) for c in ("external_id", "full_name", "resume_file")]), {"ignoreNullFields": "false"}).alias("_who"))
    told = hits.join(who, "record_idx").select(F.col("resume_idx").alias("record_idx"), "_who")
    payload = F.when(F.col("_who").isNotNull(), F.concat(F.regexp_replace("raw_payload", r"\}$", ""), F.lit(',"matched_candidate":'), "_who", F.lit("}"))).otherwise(F.col("raw_payload"))
    annotated = good.join(told, "record_idx", "left").withColumn("raw_payload", payload).drop("_who")
    named = records.where(S.file_key(F.col("resume_file")).isNotNull()).groupBy(S.file_key(F.col("resume_file")).alias("_key")).agg(F.min(F.struct("record_idx", "full_name"))["full_name"].alias("candidate"))
    file = S.base_name(F.col("source.source_uri"))
    failures = bad.select(file.alias("resume_file"), S.file_key(file).alias("_key"), F.col("error").alias("reason")).join(named, "_key", "left")
    return append(records, annotated), failures.select("resume_file", "candidate", "reason")


def _list(v: Column, path: str, objects: bool) -> Column:
    items = F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    as_text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
    return F.transform(items, (lambda x: F.to_json(x)) if objects else as_text)


def add_insights(records: DataFrame, answers: DataFrame, model: str = "external") -> DataFrame:
    """Records with what a model's answers (record_idx, payload: JSON text) add.

    Scalars fill only what is missing, lists append what is new, and the rest of an answer goes to the payload
    under ``ai_enrichment``.  A record without an answer, or with one that is no object holding ``candidate_record``,
    stays as it is with the status ``unavailable``.
    """
    parsed = answers.select("record_idx", F.try_parse_json("payload").alias("_v"))
    body = F.try_variant_get("_v", "$.candidate_record", "variant")
    joined = records.join(parsed.withColumn("_c", F.when(F.schema_of_variant(body).startswith("OBJECT"), body)), "record_idx", "left")
    ok = F.col("_c").isNotNull()
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    kind = lambda c: "double" if c == "years_experience" else "string"
    cols = {c: F.when(ok & blank(c), F.coalesce(F.nullif(F.try_variant_get("_c", f"$.{c}", kind(c)), F.lit("" if kind(c) == "string" else None)), F.col(c))).otherwise(F.col(c)) for c in AI_SCALARS}
    # strings are told apart as they are, objects by their JSON
    key = lambda c: (lambda x: F.coalesce(S.json_key(x), x)) if c in AI_OBJECTS else (lambda x: S.fold(x))
    cols |= {c: F.when(ok, S.distinct_by(F.concat(F.coalesce(c, F.array()), _list(F.col("_c"), c, c in AI_OBJECTS)), key(c))).otherwise(F.col(c)) for c in AI_LISTS}
    insight = {k: F.when(ok, F.to_json(F.try_variant_get("_v", f"$.{k}", "variant"))) for k in (*INSIGHTS, "ai_summary")}
    parts = [F.concat(F.lit('"status":'), F.when(ok, F.lit('"available"')).otherwise(F.lit('"unavailable"'))), F.concat(F.lit('"model":'), S.json_text(F.lit(model)))]
    parts += [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null" if k == "ai_summary" else "[]"))) for k, v in insight.items()]
    told = F.concat(F.lit('"ai_enrichment":{'), F.concat_ws(",", *parts), F.lit("}"))
    payload = F.when(F.col("raw_payload").rlike(r"^\{.+\}$"), F.concat(F.regexp_replace("raw_payload", r"\}$", ","), told, F.lit("}"))).otherwise(F.concat(F.lit("{"), told, F.lit("}")))
    return joined.withColumns(cols).withColumn("raw_payload", payload).select(*records.columns)


def ask(records: DataFrame, complete: Callable[[str], dict], retries: int = 1) -> DataFrame:
    """(record_idx, payload): a client's answer for each record's JSON; null where it fails ``retries`` + 1 times.

    ``complete`` takes the record as JSON text and returns the answer as a dict.
    """
    import json

    def call(batches):
        for frame in batches:
            out = []
            for text in frame["record"]:
                answer = None
                for _ in range(retries + 1):
                    try:
                        answer = json.dumps(complete(text))
                        break
                    except Exception:  # an answer that does not come leaves the record as it is
                        continue
                out.append(answer)
            yield frame[["record_idx"]].assign(payload=out)

    return records.select("record_idx", F.to_json(F.struct(*[c for c in records.columns if c != "raw_payload"])).alias("record")).mapInPandas(call, "record_idx long, payload string")


def unavailable(records: DataFrame) -> DataFrame:
    """(unavailable): whether any record lacks an answer."""
    status = F.get_json_object("raw_payload", "$.ai_enrichment.status")
    return records.agg(F.coalesce(F.max(status == "unavailable"), F.lit(False)).alias("unavailable"))


def insights(merged: DataFrame) -> DataFrame:
    """(cluster_id, ai_summary, strengths, ...): what answers say of all members of a merged record, lists united in rank order."""
    answers = F.filter(F.transform("merged_from", lambda m: F.try_variant_get(F.try_parse_json(m["raw_payload"]), "$.ai_enrichment", "variant")), lambda x: x.isNotNull())
    found = merged.select("cluster_id", answers.alias("a"))
    first = F.get(F.filter(F.transform("a", lambda x: F.nullif(F.try_variant_get(x, "$.ai_summary", "string"), F.lit(""))), lambda x: x.isNotNull()), 0)
    return found.select("cluster_id", first.alias("ai_summary"), *[F.array_distinct(F.flatten(F.transform("a", _of(k)))).alias(k) for k in INSIGHTS])


def _of(name: str):
    return lambda x: _list(x, name, False)


def insight_rows(found: DataFrame) -> DataFrame:
    """(cluster_id, section, position, value): insights as they are shown, a row a line; a candidate without any has one row that says so."""
    titles: Sequence[tuple[str, str]] = (("strengths", "Strengths"), ("suggested_roles", "Suggested Roles"), ("responsibilities", "Responsibilities"), ("achievements", "Achievements"), ("potential_missing_information", "Potential Missing Information"), ("field_confidences", "Field Confidence"))
    row = lambda title, v: F.struct(F.lit(title).alias("section"), v.alias("value"))
    lists = F.concat(*[F.transform(k, _row(title)) for k, title in titles])
    any_ = F.col("ai_summary").isNotNull() | (F.size(F.concat(*INSIGHTS)) > 0)
    rows = F.when(any_, F.concat(F.array(row("AI Summary", F.coalesce("ai_summary", F.lit("-")))), lists)).otherwise(F.array(row("AI Insights", F.lit("No AI insights available."))))
    return found.select("cluster_id", F.posexplode(rows).alias("position", "r")).select("cluster_id", "r.section", "position", "r.value")


def _row(title: str):
    return lambda x: F.struct(F.lit(title).alias("section"), x.alias("value"))

"""From records of several sources to one projected, validated candidate a person."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from mergewell.operators import clustering, enrich, matching, merging, output, scoring
from mergewell.operators.normalize import normalize


@dataclass(frozen=True)
class Result:
    """Lazy frames of a run; ``quarantine`` holds candidates that a strict reader would refuse.

    ``failures`` are résumés that could not be read, ``warnings`` links without a profile, ``insights`` and
    ``ai_unavailable`` tell of a model's answers; each is None where its stage had nothing to do.
    """

    records: DataFrame
    matches: DataFrame
    clusters: DataFrame
    merged: DataFrame
    candidates: DataFrame
    quarantine: DataFrame
    output: DataFrame
    report: DataFrame
    sources: DataFrame
    error_count: DataFrame
    warnings: DataFrame | None = None
    failures: DataFrame | None = None
    insights: DataFrame | None = None
    ai_unavailable: DataFrame | None = None

    def events(self) -> DataFrame:
        """The match by which each record joined each group, with both records' names and sources; worked out when asked for."""
        return clustering.described(clustering.events(self.matches), self.records, self.clusters)


def run(
    records: DataFrame,
    config: output.Config | dict | str,
    fuzzy: bool = True,
    fail_fast: bool = False,
    profiles: DataFrame | None = None,
    fetch=None,
    resumes: DataFrame | None = None,
    answers: DataFrame | None = None,
) -> Result:
    """Enrich, add résumés, normalize, match, cluster, merge, score, canonicalize, project and validate.

    ``profiles`` is a table (login, v, repos) and ``fetch`` a client for links to profiles; ``resumes`` has (record_idx, path, text[, error]);
    ``answers`` has a model's (record_idx, payload) and counts only if the configuration says ``use_ai``.
    With ``fail_fast`` a candidate with errors stops the run; else it goes to the quarantine.
    """
    config = output.Config.of(config)
    warnings = failures = None
    if profiles is not None or fetch is not None:
        records, warnings = enrich.enrich_profiles(records, profiles, fetch)
    if resumes is not None:
        records, failures = enrich.add_resumes(records, resumes)
    if config.use_ai:
        none = records.sparkSession.createDataFrame([], "record_idx long, payload string")
        records = enrich.add_insights(records, none if answers is None else answers)
    # written once: matching, merging and the reports all read it
    normal = clustering.checkpointed(normalize(records))
    found = matching.matches(normal, fuzzy)
    clusters = clustering.components(normal, matching.linked(normal) if fuzzy else found)
    merged = scoring.score(merging.merge(normal, clusters, config.source_priorities))
    candidates = output.canonical(merged)
    bad = candidates.where("size(errors) > 0")
    if fail_fast and bad.limit(1).count():
        raise ValueError("a candidate cannot be put out: " + str(bad.select("candidate_id", "errors").first()))
    good = candidates.where("size(errors) = 0")
    projected = output.validate(output.project(good, config), config)
    return Result(
        normal, found, clusters, merged, good, bad, projected, output.merge_report(normal, clusters), output.contributing(merged), output.error_count(projected),
        warnings, failures, enrich.insights(merged) if config.use_ai else None, enrich.unavailable(normal) if config.use_ai else None,
    )

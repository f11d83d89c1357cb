"""Normalization of whole records in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S


def normalize(records: DataFrame, region: str = "US") -> DataFrame:
    """Normal forms in place; e-mails and phones that have none are dropped, a location keeps its stripped text."""
    some = lambda c, f: S.dedup_ci(F.filter(F.transform(c, f), lambda x: x.isNotNull()))
    return records.withColumns(
        {
            "emails": some("emails", S.email),
            "phones": some("phones", lambda x: S.phone(x, region)),
            "skills": S.skills(F.col("skills")),
            "links": S.dedup_ci(F.col("links")),
            "certifications": S.dedup_ci(F.col("certifications")),
            "location": S.location(F.col("location"))["raw"],
        }
    )

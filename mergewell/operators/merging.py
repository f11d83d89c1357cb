"""One record a cluster: ranked by source priority, scalars coalesced, lists united in order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.schema import OBJECT_LISTS, SCALARS, STRING_LISTS

MERGED = "merge_engine"


def priority(priorities: Mapping[str, int] | None) -> Column:
    """The higher of a source's type and name priorities, 0 for unknown ones."""
    if not priorities:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    of = lambda c: F.coalesce(F.element_at(table, F.col(c)), F.lit(0))
    return F.greatest(of("source.source_type"), of("source.source_name"))


def ranked(records: DataFrame, priorities: Mapping[str, int] | None = None) -> DataFrame:
    """Add ``rank``, what members of a cluster are sorted by; later records stand first among equals."""
    name = lambda c: F.coalesce(c, F.lit(""))
    return records.withColumn("priority", priority(priorities)).withColumn(
        "rank",
        F.struct(-F.col("priority"), F.col("source.source_type"), name(F.col("source.source_name")), name(F.col("source.source_record_id")), -F.col("record_idx")),
    )


def label() -> Column:
    return F.coalesce("source.source_name", "source.source_type")


def merge(records: DataFrame, clusters: DataFrame, priorities: Mapping[str, int] | None = None) -> DataFrame:
    """Merged records with ``cluster_id``, ``members`` and ``merged_from``; a lone record is merged too.

    One shuffle on the cluster; a cluster's members meet in one row, as the merged record must.
    """
    rows = ranked(records.join(clusters, "record_idx"), priorities)
    own = label()
    qualified = F.transform("raw_values", lambda x: F.struct(x["field_name"].alias("field_name"), F.concat(own, F.lit(":"), F.coalesce(x["source_key"], x["field_name"])).alias("source_key"), x["value"].alias("value")))
    rows = rows.withColumn("raw_values", qualified).withColumn("from", F.struct(own.alias("label"), F.col("priority"), F.col("source"), F.col("raw_payload")))
    fields = [*SCALARS, "years_experience", *STRING_LISTS, *OBJECT_LISTS, "raw_values", "source", "from", "record_idx"]
    grouped = rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("r")))).alias("m"))
    grouped = grouped.withColumn("m", F.transform("m", lambda x: x["r"]))
    first = lambda c: F.get(F.filter(F.transform("m", lambda x: x[c]), lambda v: v.isNotNull() & (v.cast("string") != "")), 0)
    union = lambda c: F.flatten(F.transform("m", lambda x: F.coalesce(x[c], F.array())))

    columns = {c: first(c) for c in (*SCALARS, "years_experience")}
    columns |= {c: S.dedup_ci(union(c)) for c in STRING_LISTS}
    columns |= {c: S.distinct_by(union(c), lambda x: F.coalesce(S.json_key(x), x)) for c in OBJECT_LISTS}
    columns["raw_values"] = S.distinct_by(union("raw_values"), lambda x: F.to_json(x))
    out = grouped.select(
        F.col("cluster_id"),
        F.transform("m", lambda x: x["record_idx"]).alias("members"),
        F.array_max(F.transform("m", lambda x: x["record_idx"])).alias("record_idx"),
        *[c.alias(n) for n, c in columns.items()],
        F.transform("m", lambda x: x["from"]).alias("merged_from"),
        F.array_min(F.transform("m", lambda x: x["source"]["ingested_at"])).alias("_at"),
        F.get("m", 0)["source"]["source_uri"].alias("_uri"),
    )
    source = F.struct(F.lit("other").alias("source_type"), F.lit(MERGED).alias("source_name"), F.col("external_id").alias("source_record_id"), F.col("_uri").alias("source_uri"), F.col("_at").alias("ingested_at"))
    return out.withColumn("source", source).drop("_at", "_uri")

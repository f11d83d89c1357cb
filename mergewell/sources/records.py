"""What all scans share: shaping, checking and appending records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.schema import STRING_LISTS, TYPES


class SourceError(ValueError):
    """A source that cannot be read at all."""


def as_records(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the record's columns, missing ones null or empty, with an ``error`` column kept if there is one."""
    out = []
    for name, kind in TYPES.items():
        c = columns.get(name, F.array() if kind.startswith("array") else F.lit(None))
        out.append(c.cast(kind).alias(name))
    return df.select(*out, *(["error"] if "error" in df.columns else []))


def source(kind: str, name: Column | str, record_id: Column, uri: Column, ingested_at: str) -> Column:
    """The source struct; the time is a run's parameter so that results repeat."""
    label = name if isinstance(name, Column) else F.lit(name)
    return F.struct(F.lit(kind).alias("source_type"), label.alias("source_name"), record_id.cast("string").alias("source_record_id"), uri.alias("source_uri"), F.lit(ingested_at).cast("timestamp").alias("ingested_at"))


def checked(df: DataFrame) -> DataFrame:
    """Trim and dedup lists; add to ``error`` what breaks a record's rules."""
    for c in STRING_LISTS:
        df = df.withColumn(c, S.dedup_ci(F.transform(F.coalesce(c, F.array()), S.strip_ws)))
    blank = reduce(lambda a, b: a | b, [F.array_contains(c, "") for c in STRING_LISTS])
    years = F.col("years_experience")
    problem = F.when(blank, "blank list item").when(F.isnan(years) | (years < 0), "years_experience is not a number from 0 on")
    kept = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.coalesce(kept, problem))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) by ``error``."""
    return df.where("error is null").drop("error"), df.where("error is not null")


def append(*frames: DataFrame) -> DataFrame:
    """Records of several inputs one after the other; ``record_idx`` numbers them by input, then by row.

    Rows of an input are numbered in its own ``record_idx``; an input's numbers start where the ones before end.
    """
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_input", F.lit(i)) for i, f in enumerate(frames)])
    twice = tagged.groupBy("_input", "record_idx").count().where("count > 1").limit(1).collect()
    if twice:
        raise SourceError(f"input {twice[0]['_input']} numbers two rows {twice[0]['record_idx']}")
    sizes = tagged.groupBy("_input").agg((F.max("record_idx") + 1).alias("n"))
    before = Window.orderBy("_input").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_input", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return tagged.join(F.broadcast(starts), "_input").withColumn("record_idx", F.col("record_idx") + F.col("_start")).select(*TYPES)

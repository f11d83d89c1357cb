"""Where projected candidates go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(projected: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, in files below ``path``; nothing is collected."""
    projected.where("output is not null").select(F.col("output").alias("value")).write.mode(mode).text(path)


def read_json(spark, path: str) -> DataFrame:
    """(output) of a folder written by :func:`write_json`."""
    return spark.read.text(path).select(F.col("value").alias("output"))


def records_of(projected: DataFrame) -> Iterable[str]:
    """The JSON texts one by one in cluster order, for a caller that has room for one partition at a time."""
    for row in projected.orderBy("cluster_id").select("output").toLocalIterator():
        yield row["output"]


def one(candidates: DataFrame, projected: DataFrame, cluster_id: int) -> DataFrame:
    """(file_name, content): one candidate's JSON, indented, under the candidate's id."""
    who = candidates.where(F.col("cluster_id") == cluster_id).select("cluster_id", "candidate_id")
    pretty = F.to_json(F.try_parse_json("output"), {"pretty": "true"})
    return projected.join(who, "cluster_id").select(F.concat("candidate_id", F.lit(".json")).alias("file_name"), pretty.alias("content"))

"""Delimited files as they arrive: each batch is mapped, normalized and appended, bad rows to a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mergewell.operators.normalize import normalize
from mergewell.sources import delimited
from mergewell.sources.records import split_valid


def ingest_folder(spark: SparkSession, folder: str, columns: list[str], records_path: str, quarantine_path: str, checkpoint: str, mapping: delimited.ColumnMapping | None = None) -> StreamingQuery:
    """Start a query that takes what lies in the folder now, and stops; run it again for what came since.

    ``columns`` is the files' header.  A batch goes to a folder of its own number, which a retry overwrites, so nothing is taken twice.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    stream = spark.readStream.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(folder)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("record_idx", F.monotonically_increasing_id())
        good, bad = split_valid(delimited.from_frame(rows, mapping))
        normalize(good).write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Clusters of matched records: connected components, and the matches that fused them, written out round by round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that the session names; only a session without executors of its own gets one where none is named."""
    spark: SparkSession = df.sparkSession
    if not (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="mergewell-"))
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def components(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_idx, cluster_id): the least index that a record is connected with; a record alone is its own.

    Each round spreads least labels along edges and doubles jumps, so rounds grow with the
    logarithm of a chain's length.  A label's old value travels with the new one, so whether any moved needs no join.
    """
    both = pairs.select(F.col("left").alias("a"), F.col("right").alias("b"))
    edges = checkpointed(both.union(both.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        up = labels.alias("x").join(labels.alias("y"), F.col("x.root") == F.col("y.node")).select("x.node", F.col("x.root").alias("own"), F.col("y.root").alias("root"))
        down = up.select(F.col("own").alias("node"), "root")
        told = heard.union(down).withColumn("own", F.lit(None).cast("bigint")).select("node", "own", "root").union(up)
        fresh = checkpointed(told.groupBy("node").agg(F.max("own").alias("own"), F.least(F.min("root"), F.max("own")).alias("root")))
        labels = fresh.select("node", "root")
        if not fresh.where("root <> own").limit(1).count():
            break
    return records.select("record_idx").join(labels.withColumnRenamed("node", "record_idx"), "record_idx", "left").select("record_idx", F.coalesce("root", "record_idx").alias("cluster_id"))


def ordered(clusters: DataFrame) -> DataFrame:
    """Clusters in output order, by their latest record: (cluster_id, size, latest)."""
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.max("record_idx").alias("latest")).orderBy("latest")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up), a root being its own parent, by doubling jumps."""
    while True:
        jumped = parents.alias("x").join(parents.alias("y"), F.col("x.up") == F.col("y.node")).select("x.node", F.col("x.up").alias("old"), F.col("y.up").alias("up"))
        jumped = checkpointed(jumped)
        if not jumped.where("up <> old").limit(1).count():
            return jumped.select("node", F.col("up").alias("root"))
        parents = jumped.select("node", "up")


def events(matched: DataFrame) -> DataFrame:
    """(left, right, rule, confidence, reason): the match by which a record joined each group that stood before it.

    Records come one by one; a record that matches several groups fuses them and gives one event for
    each, its most confident match there, of equals the latest record's.  That is the least spanning forest of
    the matches in the order (left, -confidence, -right): the first match that connects a record with a group is
    that group's event, all others close circles.  Each round every component picks its first match to another one.
    """
    rank = F.struct("left", (-F.col("confidence")).alias("doubt"), (-F.col("right")).alias("behind"))
    edges = checkpointed(matched.select(F.col("left").alias("a"), F.col("right").alias("b"), rank.alias("w")))
    taken = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        first = both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.w").alias("w"))
        first = checkpointed(first)
        if not first.limit(1).count():
            break
        taken = first.select("w") if taken is None else taken.union(first.select("w"))
        back = first.select(F.col("a").alias("b2"), F.col("b").alias("a2"))
        ups = first.join(back, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left").select(F.col("a").alias("node"), F.when(F.col("b2").isNotNull() & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up"))
        roots = _roots(checkpointed(ups))
        moved = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        edges = checkpointed(moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("w").alias("w")))
    if taken is None:
        return matched.select("left", "right", "rule", "confidence", "reason").limit(0)
    chosen = taken.distinct().select(F.col("w.left").alias("left"), (-F.col("w.behind")).alias("right"))
    return matched.join(chosen, ["left", "right"]).select("left", "right", "rule", "confidence", "reason")


def described(found: DataFrame, records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Events with the cluster, and both records' names and source types."""
    who = lambda p: records.select(F.col("record_idx").alias(p), F.col("full_name").alias(f"{p}_candidate"), F.col("source.source_type").alias(f"{p}_source"))
    return found.join(who("left"), "left").join(who("right"), "right").join(clusters.withColumnRenamed("record_idx", "left"), "left")

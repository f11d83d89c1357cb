"""Rendezvous sharding: stable keys over weighted shards.

For each record every shard draws ``-ln(u) / weight`` with ``u`` uniform in (0, 1) from a
hash of (key, shard); the lowest draw wins.  A shard's share follows its weight, and adding
a shard moves only those records that the new one wins: about ``w_new / w_all`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that share one numbering block, about; blocks bound the sort behind a slot.
BLOCK_ROWS = 50_000


def draw(key: Column, shard: str, weight: float) -> Column:
    """The shard's draw for a key: exponential with rate ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, shards: Sequence[tuple[str, float]]) -> Column:
    """Index in ``shards`` of the shard that wins a key.

    ``shards`` lists (name, weight); a shard's draws depend on its own name and weight alone.
    A null key counts as one key of its own.
    """
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("shards need at least one entry, each of a positive weight")
    key = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    draws = F.array(*[F.struct(draw(key, name, w).alias("draw"), F.lit(i).alias("at")) for i, (name, w) in enumerate(shards)])
    return F.array_min(draws)["at"].cast("int")


def assign(
    df: DataFrame,
    key: str,
    shards: Sequence[tuple[str, float]],
    grown: Sequence[tuple[str, float]] | None = None,
    order: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``shard``, ``slot`` and, where ``grown`` is given, ``grown_shard``.

    The key alone decides the shard.  Slots are gapless from 0 within a shard: rows fall into
    hashed blocks of about ``block_rows``, are numbered inside their block in ``order`` (the
    key first), and each block starts where the blocks before it in its shard end, so that no
    task ever sorts a whole shard.  Rows equal in every ordering column are interchangeable.
    Columns named like the added ones are replaced.  An empty table gives an empty result.
    """
    order = list(order or [key])
    df = df.drop("shard", "slot", "grown_shard", "_block", "_at", "_rows", "_start")
    df = df.withColumn("shard", shard_of(F.col(key), shards))
    if grown is not None:
        df = df.withColumn("grown_shard", shard_of(F.col(key), grown))
    rows = df.count()
    blocks = max(1, -(-rows // (block_rows * len(shards))))
    df = df.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), *[F.col(c) for c in order]), F.lit(blocks)).cast("int"))
    inside = Window.partitionBy("shard", "_block").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = df.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select("shard", "_block", "_start")
    )
    out = numbered.join(starts, ["shard", "_block"]).withColumn("slot", F.col("_start") + F.col("_at"))
    return out.drop("_block", "_at", "_start")


def even_shards(n: int) -> list[tuple[str, float]]:
    """``n`` shards of equal weight, named by their number."""
    return [(str(i), 1.0) for i in range(n)]


def op3_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15 by their doc_id; ``grown_shard`` is their place among 17.

    Null text has size 1 and the checksum of no bytes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = assign(sized, "doc_id", even_shards(16), even_shards(17), order=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op3_rendezvous_sharding": op3_rendezvous_sharding}
ORACLE_SQL: dict[str, str] = {}

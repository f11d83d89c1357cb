"""What the corpus operators share: words, scratch tables, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    A chain of columns would do as well until a filter is pushed below it and every name is
    replaced by its definition; a bound variable is never copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(xs: Column, op) -> Column:
    """``op`` over all values up to each place.  Chunk by chunk, then over the chunks' ends, so that what is
    copied stays near linear in the array's length."""

    def within(a: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.get(acc, F.size(acc) - 1), x)).otherwise(x)))
        return F.aggregate(a, F.array().cast("array<int>"), step)

    def joined(chunks: Column) -> Column:
        ends = within(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(chunks, lambda c, k: F.when(k == 0, c).otherwise(F.transform(c, lambda x: op(F.get(e, k - 1), x))))))

    def cut_up(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(RUNNING_CHUNK))
        return F.when(F.size(v) > 0, let(F.transform(starts, lambda s: within(F.slice(v, s, F.lit(RUNNING_CHUNK)))), joined)).otherwise(F.array().cast("array<int>"))

    return let(xs, cut_up)


#: Values of an array that are summed one by one before chunks are.
RUNNING_CHUNK = 128


def running_sum(xs: Column) -> Column:
    """Sums of an array of ints up to each place."""
    return _running(xs, lambda a, b: a + b)


def running_top(xs: Column) -> Column:
    """Largest of an array of ints up to each place."""
    return _running(xs, F.greatest)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session has it.

    Only a session without executors of its own (as in tests) gets a local one where none is named;
    on a cluster that is an error, as each machine would write to its own disk.
    """
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="mergewell-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/mergewell/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a written Parquet table in the shared folder, and reread it.

    A lost executor costs its running tasks only: what is written stays readable by all.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


#: A side of a join is broadcast only if what it holds was measured and is so much at most.
BROADCAST_BYTES = 8 << 20


def _bytes_of(c: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        flat = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType))
        each = F.size(c) * 8 if flat else F.aggregate(c, F.lit(0), lambda acc, x: acc + _bytes_of(x, kind.elementType).cast("int"))
        return F.coalesce(each, F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcasting if its rows, measured now, take few bytes; else joins shuffle.

    For frames that are cheap to read, as written tables are.
    """
    each = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()["b"] <= most else df


def discard(df: DataFrame) -> None:
    """Remove the table behind a frame from :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """How many partitions hold ``rows`` at about ``per_partition`` each, never under the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))

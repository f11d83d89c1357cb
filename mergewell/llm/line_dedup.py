"""Repeated runs of lines, found by a suffix array over line ids, in DataFrame operations only.

Every line with a word gets an id: the place where the same line first stands.  Prefix doubling
then ranks suffixes by their first 1, 2, 4, ... lines.  A round pairs a suffix's rank with the
rank of the suffix that far behind it, and equal pairs get one new rank, again the first place
where they stand; suffixes that no other shares leave the array, as they are sorted for good.
Ranks are taken by a hash aggregate of pairs, never by sorting a bucket, so a line that a third
of all documents share is summed before it is moved.

Suffixes of one rank are an interval of the suffix array whose common prefix is at least so many
lines.  A run counts if it holds ``min_words`` words or more.  All copies but the first of each
are deleted.  The shortest such run at a place is at most ``min_words`` lines long, and its lines
decide how long it is, so doubling stops there.

The shortest runs alone miss short lines at the end of a longer repeated run, behind the line that
makes up the words.  With ``maximal`` a place's runs are also tried longer, as long as the lines
behind its first hold less than ``min_words`` words, which is ``min_words`` lines at most again.
Together these cover every repeated run that counts: a line of it either has ``min_words`` words
from itself to the run's end, and the shortest run at that line holds it, or it has not, and then
it stands in the run from the last line that has to the end, whose lines behind the first hold less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm.common import cut, discard, let

#: Words that a repeated run of lines must hold to be deleted.
MIN_WORDS = 8
_WORD = r"[^\x20\x09-\x0D]"
_KEY = ("d", "th")


def _word_lines(text: Column) -> Column:
    """The lines with a word: struct(x: the line, at: its number among all lines, n: its words)."""
    gaps = r"[\x20\x09-\x0D]+"
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("at"), F.size(F.filter(F.split(x, gaps), lambda w: w != "")).alias("n")))
    return F.filter(lines, lambda s: s["n"] > 0)


def _shortest(lines: Column, i: Column, min_words: int) -> Column:
    """How many lines from the i-th on hold ``min_words`` words; null if the text ends before."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("k"))

    def step(acc, s):
        more = acc["words"] < min_words
        return F.struct(F.when(more, acc["words"] + s["n"]).otherwise(acc["words"]).alias("words"), F.when(more, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.slice(lines, i + 1, F.lit(min_words)), start, step, lambda acc: F.when(acc["words"] >= min_words, acc["k"]))


def _furthest(lines: Column, i: Column, min_words: int) -> Column:
    """How many lines from the i-th on, the first aside, hold less than ``min_words`` words."""
    start = F.struct(F.lit(0).alias("words"), F.lit(1).alias("k"))

    def step(acc, s):
        words = acc["words"] + s["n"]
        return F.struct(words.alias("words"), F.when(words < min_words, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.slice(lines, i + 2, F.lit(min_words)), start, step, lambda acc: acc["k"])


def _places(docs: DataFrame, min_words: int, maximal: bool) -> DataFrame:
    """(d, th, i, e, line): each line with a word, its 128-bit hash, and its shortest run that counts.

    With ``maximal`` also ``far``, the longest run to try.
    """

    def row(v: Column, s: Column, i: Column) -> Column:
        far = [_furthest(v, i, min_words).alias("far")] if maximal else []
        return F.struct(i.alias("i"), _shortest(v, i, min_words).alias("e"), *far, F.unhex(F.md5(s["x"])).alias("line"))

    rows = let(_word_lines(F.col("text")), lambda v: F.transform(v, lambda s, i: row(v, s, i)))
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), F.explode(rows).alias("s")).select(*_KEY, "s.*")


def _same(a: str, b: str) -> Column:
    """Two sides stand in one document; a null id equals itself."""
    return F.col(f"{a}.d").eqNullSafe(F.col(f"{b}.d")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _pairs(left: DataFrame, ranks: DataFrame, offset: Column | int) -> DataFrame:
    """``left`` with ``next``, the rank of the suffix ``offset`` lines behind; without one a row leaves."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return left.withColumn("to", F.col("i") + at).alias("l").join(ranks.alias("r"), _same("l", "r") & (F.col("l.to") == F.col("r.i"))).select("l.*", F.col("r.rank").alias("next")).drop("to")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` another place shares, with ``rank``, the first such place."""
    place = F.struct("d", "th", "i")
    first = rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    kept = [c for c in rows.columns if c not in (*by, "rank")]
    return rows.join(first, by).select(*kept, F.col("first").alias("rank"))


def _spans(ranks: DataFrame, width: int, maximal: bool) -> DataFrame:
    """``ranks`` with ``e`` and ``span``, the runs to try of more than ``width`` lines, up to twice as many."""
    if not maximal:
        return ranks.where((F.col("e") > width) & (F.col("e") <= 2 * width)).withColumn("span", F.col("e"))
    tried = ranks.where((F.greatest("e", "far") > width) & (F.col("e") <= 2 * width))
    to = F.least(F.greatest("e", "far"), F.lit(2 * width))
    return tried.withColumn("span", F.explode(F.sequence(F.greatest(F.col("e"), F.lit(width + 1)), to))).drop("far").withColumn("e", F.col("span"))


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, maximal: bool = False) -> DataFrame:
    """(d, th, i, e): runs of ``e`` lines from the i-th line with a word that stand earlier too.

    The shortest that counts at each place; with ``maximal`` all that the longest ones are made of.

    Earlier means a smaller doc_id (null before all), with equal ids a smaller text hash, or an
    earlier line of the same document.  Rows equal in doc_id and text are one document.
    """
    ranks = cut(_ranked(_places(docs, min_words, maximal), ["line"]), "ranks-1")
    later = F.col("rank") < F.struct("d", "th", "i")
    found, held, width = ranks.where((F.col("e") == 1) & later).select(*_KEY, "i", "e"), [ranks], 1
    while width < min_words:
        ends = _spans(ranks, width, maximal)
        ends = _ranked(_pairs(ends, ranks, F.col("e") - width).withColumnRenamed("rank", "start"), ["start", "next", "span"])
        found = found.union(ends.where(later).select(*_KEY, "i", "e"))
        width *= 2
        if width < min_words:
            ranks = cut(_ranked(_pairs(ranks, ranks, width // 2).withColumnRenamed("rank", "start"), ["start", "next"]), f"ranks-{width}")
            held.append(ranks)
    out = cut(found, "later-runs")
    for h in held:
        discard(h)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, maximal: bool = True) -> DataFrame:
    """Documents of (doc_id, text, ...) without later copies of repeated runs of lines.

    Every repeated run of ``min_words`` words or more goes; without ``maximal`` only the shortest such run
    at each place, which is cheaper and leaves short lines at the end of longer runs.

    Adds ``n_lines`` (lines with a word), ``n_removed`` and ``n_runs`` (maximal stretches of
    removed ones); columns of these names are replaced.  Lines without a word stay where they
    are and do not break runs.  Null texts stay null, empty ones empty; repeated rows are treated
    alike; an empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    names = docs.columns
    lines = later_runs(docs, min_words, maximal).select(*_KEY, F.explode(F.sequence(F.col("i"), F.col("i") + F.col("e") - 1)).alias("j"))
    gone = lines.groupBy(*_KEY).agg(F.sort_array(F.collect_set("j")).alias("_gone"))
    out = docs.withColumn("_th", F.xxhash64("text")).alias("l").join(gone.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.d")) & (F.col("l._th") == F.col("r.th")), "left")
    out = out.select("l.*", "_gone")
    at = F.transform(_word_lines(F.col("text")), lambda s: s["at"])
    out = out.withColumn("n_lines", F.size(at).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    steps = F.filter(F.col("_gone"), lambda j, k: (k == 0) | (F.get(F.col("_gone"), k - 1) < j - 1))
    out = out.withColumn("n_runs", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(steps)).cast("long"))

    def rest(v: Column) -> Column:
        dropped = let(at, lambda w: F.transform(F.col("_gone"), lambda j: F.get(w, j)))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), dropped), lambda k: F.get(v, k)), "\n")

    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest)))
    return out.select(*names, "n_lines", "n_removed", "n_runs")


def op5_maximal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in every whole text of ``documents`` once every repeated run of ``MIN_WORDS`` words or more is gone.

    Null and empty texts have no lines; edge cases as in :func:`dedup_lines`; other columns are not read.
    """
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op5_maximal_runs": op5_maximal_runs}
ORACLE_SQL = {
    "op5_maximal_runs": r"""
WITH l AS (
  SELECT doc_id, pos, x, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE n > 0
), p AS (
  SELECT a.doc_id, a.i, a.n, b.doc_id AS other, a.i - b.i AS behind FROM w a JOIN w b ON a.x = b.x AND (b.doc_id, b.i) < (a.doc_id, a.i)
), r AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, behind ORDER BY i) AS run FROM p
), h AS (
  SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id, other, behind, run) AS words FROM r
), g AS (
  SELECT DISTINCT doc_id, i FROM h WHERE words >= 8
), m AS (
  SELECT l.doc_id, l.pos, l.x, w.i, g.i IS NOT NULL AS gone
  FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.pos = l.pos LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = w.i
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, i IS NULL ORDER BY pos), false) AS starts FROM m
)
SELECT doc_id, count(i) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM s GROUP BY doc_id
""",
}

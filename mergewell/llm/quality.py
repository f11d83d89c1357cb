"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base rules come first.  On top of them each (rule, stratum) gets a cutoff from labelled
documents: good ones serve as a holdout that bounds how many good documents a cutoff
rejects.  A cutoff passes when the exact binomial tail says that a false-rejection rate of
``alpha`` or more is implausible: ``P(Bin(n, alpha) <= k) <= delta / tests`` for ``k`` of
``n`` good documents above it, which is the one-sided Clopper-Pearson bound turned round.
``tests`` counts every (rule, stratum) that there could be: Bonferroni across them, and fixed-sequence
testing from the most lenient cutoff inwards within each, so the family-wise error stays at ``delta``.
The rules of a stratum share ``alpha`` by ``SHARES``, which are set beforehand.
A stratum with so few good labels that not even a cutoff which rejects none of them could pass is
pooled with all others of that kind; the bound then holds for the pool.  Of the cutoffs that pass, the one
is taken that catches most bad documents less ``(1 - alpha) / alpha`` for each good one, the most lenient among
equals: so a good document weighs as many bad ones as keep wrong rejections under ``alpha`` of all rejections.
A stratum without any label, and a pool with too few, gets no cutoff and keeps all that the base rules keep.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergewell.llm.common import cut, if_small, let, words_of

#: Share of good documents that all rules of a stratum together may reject, and the chance to be wrong about it.
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs are tried on this many even steps of each rule's score (0 to 1).
STEPS = 50
RULES = ("symbols", "capitals", "dup_lines", "shouts")
#: How the rules share ``alpha``.
SHARES = {"symbols": 0.4, "capitals": 0.2, "dup_lines": 0.2, "shouts": 0.2}


def window_hashes(words: Column, size: int = 5) -> Column:
    """A 64-bit hash of each window of ``size`` words, in order."""
    n = F.greatest(F.size(words) - F.lit(size - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"a{k}") for k in range(size)])
    return F.transform(parts, lambda x: F.xxhash64(*[x[f"a{k}"] for k in range(size)]))


def _twins(hashes: Column) -> Column:
    """Places, ascending, of the hashes that occur more than once; sorts only where some do."""

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def sorted_pairs(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    none = F.array().cast("array<int>")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(sorted_pairs(h), places)).otherwise(none))


def repeat_words(words: Column, size: int = 5) -> Column:
    """How many words lie in a window of ``size`` words that the text has twice or more."""
    return F.aggregate(
        _twins(window_hashes(words, size)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p - acc["last"])).cast("long").alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def with_features(df: DataFrame) -> DataFrame:
    """Add the base counts and the rules' scores to a frame with ``text``; the text is read whole.

    Repeats are found per row: five-word windows are hashed, and only where some hash occurs
    twice are the (hash, place) pairs sorted to find which.  Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    has_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(has_word, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    df = df.withColumn("_w", by_words).withColumn("_l", by_lines)
    df = df.withColumn("n_words", F.col("_w.n")).withColumn("n_repeat_words", F.col("_w.r")).withColumn("n_dup_lines", F.col("_l.d"))
    df = df.withColumn("word_chars", F.length(F.translate(text, " \t\n\u000b\u000c\r", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")))
    letters = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lowered = F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    df = df.withColumn("symbols", F.least(F.lit(1.0), F.col("n_symbols") / letters))
    df = df.withColumn("capitals", F.least(F.lit(1.0), (F.length(text) - lowered) / letters))
    df = df.withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("_l.n"), F.lit(1)).cast("double"))
    df = df.withColumn("shouts", F.least(F.lit(1.0), (F.length(text) - F.length(F.translate(text, "!", ""))) / letters))
    return df.drop("_w", "_l")


def _log_choose_tail(n: Column, k: Column, alpha: Column) -> Column:
    """P(Bin(n, alpha) <= k), summed term by term: t_0 = (1-a)^n, t_j = t_(j-1) (n-j+1)/j a/(1-a), in logarithms."""
    start = n * F.log(1 - alpha)
    ratio = alpha / (1 - alpha)
    zero = F.struct(start.alias("t"), F.exp(start).alias("sum"))

    def step(acc, j):
        t = acc["t"] + F.log((n - j + F.lit(1)) / j.cast("double") * ratio)
        return F.struct(t.alias("t"), (acc["sum"] + F.exp(t)).alias("sum"))

    return F.when(k <= 0, F.exp(start)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), zero, step, lambda a: a["sum"]))


def pools(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, pool, tests) of strata with a label: a pool of its own where its good labels suffice for some cutoff, else the common one."""
    sizes = labelled.groupBy("stratum").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("n"))
    tests = F.lit(len(RULES)) * (F.count(F.lit(1)).over(Window.partitionBy()) + 1)
    least = F.log(F.lit(float(delta)) / F.col("tests")) / F.log(F.lit(1.0 - alpha * max(SHARES.values())))
    pool = F.when(F.col("n") >= least, F.concat(F.lit("="), "stratum")).otherwise(F.lit("(pooled)"))
    return sizes.withColumn("tests", tests).select("stratum", pool.alias("pool"), "tests")


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, steps: int = STEPS) -> DataFrame:
    """(stratum, rule, cutoff) of every rule that has one, from rows of (stratum, quality, the rules' scores).

    Scores are counted into ``steps`` + 1 levels before anything is moved, so what is shuffled
    is a count per (stratum, rule, level), whatever the number of labels.  A document is above
    level c if its score exceeds c / steps.
    """
    long = labelled.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score"), F.lit(alpha * SHARES[r]).alias("own_alpha")) for r in RULES])).alias("x"))
    level = F.greatest(F.ceil(F.col("x.score") * F.lit(steps)) - 1, F.lit(-1)).cast("int")
    counts = long.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.own_alpha").alias("own_alpha"), level.alias("level")).agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")
    )
    pooled = cut(pools(labelled, alpha, delta), "pools")
    counts = counts.join(pooled, "stratum").groupBy("pool", "tests", "rule", "own_alpha", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    above = Window.partitionBy("pool", "rule").orderBy(F.col("level").desc())
    whole = Window.partitionBy("pool", "rule")
    graded = (
        counts.withColumn("k", F.sum("good").over(above))
        .withColumn("caught", F.sum("bad").over(above))
        .withColumn("n", F.sum("good").over(whole))
        .where("level >= 0 and n > 0")
        .withColumn("passes", (F.col("k") < F.col("n") * F.col("own_alpha")) & (_log_choose_tail(F.col("n"), F.col("k"), F.col("own_alpha")) <= F.lit(float(delta)) / F.col("tests")))
        .withColumn("passes", F.min(F.col("passes").cast("int")).over(above) == 1)
    )
    gain = F.col("caught") - F.lit((1 - alpha) / alpha) * F.col("k")
    best = graded.where(F.col("passes") & (gain > 0)).groupBy("pool", "rule").agg(F.max(F.struct(gain.alias("gain"), "level"))["level"].alias("level"))
    return pooled.join(best, "pool").select("stratum", "rule", (F.col("level") / F.lit(float(steps))).alias("cutoff"))


def bars(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum that has a cutoff, a column ``bar_<rule>`` each, from scored documents without their texts.

    Documents without a label, with a null doc_id or with labels of both kinds teach nothing;
    rows that share a labelled doc_id each count.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    known = known.where("quality = _other").drop("_other")
    taught = scored.where(~F.col("base_failed")).select("doc_id", "stratum", *RULES).join(known, "doc_id")
    found = cut(cutoffs(taught, alpha, delta), "cutoffs")
    wide = found.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    return wide.select("stratum", *[F.col(r).alias(f"bar_{r}") for r in RULES])


def apply_bars(scored: DataFrame, wide: DataFrame) -> DataFrame:
    """Add ``kept``: neither a base rule nor a cutoff of the document's stratum rejects it."""
    out = scored.join(wide, "stratum", "left")
    over = functools.reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"bar_{r}"), F.lit(False)) for r in RULES])
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~over)).drop(*[f"bar_{r}" for r in RULES])


def with_stratum(df: DataFrame) -> DataFrame:
    """The stratum of a document is its ``lang``; null is one of its own."""
    return df.withColumn("stratum", F.coalesce(F.col("lang").cast("string"), F.lit("(none)")))


def judge(df: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Add ``base_failed``, ``kept``, the counts and scores to documents of (doc_id, text, lang, ...).

    The scores are computed once without the texts for the cutoffs, and once more beside the
    texts, which are never shuffled.  Empty and null texts fail the base rules for having under
    ten words.  Columns named like the added ones are replaced.  Empty tables give empty results.
    """
    narrow = cut(with_stratum(with_features(df.select("doc_id", "text", "lang"))).select("doc_id", "stratum", "base_failed", *RULES), "scores")
    return apply_bars(with_stratum(with_features(df)), bars(narrow, labels, alpha, delta))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of (doc_id, text, lang, ...) that neither a base rule nor a cutoff rejects.

    Scores are taken once, without the texts; rows equal in doc_id and text go if one of them does.
    """
    key = F.xxhash64("text").alias("_th")
    scored = cut(with_stratum(with_features(docs.select("doc_id", key, "text", "lang"))).select("doc_id", "_th", "stratum", "base_failed", *RULES), "scores")
    gone = apply_bars(scored, bars(scored, labels)).where(~F.col("kept")).select(F.col("doc_id").alias("_d"), "_th").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_th"))
    return docs.join(if_small(cut(gone, "rejected")), same, "left_anti")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text of ``documents``, cutoffs learnt from ``labels``.

    Null and empty texts have no words and fail; documents with a null id teach nothing but are judged;
    repeated rows each give a row; with empty labels the base rules alone decide; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = cut(with_stratum(with_features(docs)).select("doc_id", "stratum", *COUNTS, "base_failed", *RULES), "scores")
    return apply_bars(scored, bars(scored, labels)).select("doc_id", *COUNTS, "base_failed", "kept")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {
    "op6_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '(none)') AS stratum,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1)
  GROUP BY doc_id
), f AS (
  SELECT d.doc_id, stratum, t, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id
), s AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    least(1.0, n_symbols / greatest(word_chars, 1)::DOUBLE) AS symbols,
    least(1.0, (length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g'))) / greatest(word_chars, 1)::DOUBLE) AS capitals,
    n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_lines,
    least(1.0, length(regexp_replace(t, '[^!]', '', 'g')) / greatest(word_chars, 1)::DOUBLE) AS shouts
  FROM f
), l AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)
), u AS (
  UNPIVOT (SELECT doc_id, stratum, base_failed, symbols, capitals, dup_lines, shouts FROM s) ON symbols, capitals, dup_lines, shouts INTO NAME rule VALUE score
), p AS (
  SELECT stratum, {len(RULES)} * (count(*) OVER () + 1) AS tests,
    CASE WHEN count(*) FILTER (quality = 1) >= ln({DELTA}::DOUBLE / ({len(RULES)} * (count(*) OVER () + 1))) / ln(1 - {ALPHA * max(SHARES.values())}::DOUBLE) THEN '=' || stratum ELSE '(pooled)' END AS pool
  FROM s JOIN l ON l.doc_id = s.doc_id WHERE NOT base_failed GROUP BY stratum
), k AS (
  SELECT pool, tests, rule, CASE rule {" ".join(f"WHEN '{r}' THEN {ALPHA * x}::DOUBLE" for r, x in SHARES.items())} END AS own, greatest(ceil(score * {STEPS}) - 1, -1)::INT AS level,
    count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad
  FROM u JOIN l ON l.doc_id = u.doc_id JOIN p ON p.stratum = u.stratum WHERE NOT base_failed GROUP BY ALL
), a AS (
  SELECT pool, tests, rule, own, level, sum(good) OVER w AS k, sum(bad) OVER w AS caught, sum(good) OVER (PARTITION BY pool, rule) AS n
  FROM k WINDOW w AS (PARTITION BY pool, rule ORDER BY level DESC)
), b AS (
  SELECT *, k < n * own AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(own) + (n - j) * ln(1 - own)))
    FROM (SELECT unnest(range(0, k::BIGINT + 1)) AS j)) <= {DELTA}::DOUBLE / tests AS ok
  FROM a WHERE level >= 0 AND n > 0
), q AS (
  SELECT pool, rule, level, caught - {(1 - ALPHA) / ALPHA}::DOUBLE * k AS gain, bool_and(ok) OVER (PARTITION BY pool, rule ORDER BY level DESC) AS ok FROM b
), r AS (
  SELECT p.stratum, rule, arg_max(level, (gain, level)) / {STEPS}::DOUBLE AS cutoff FROM q JOIN p ON p.pool = q.pool WHERE ok AND gain > 0 GROUP BY p.stratum, rule
), x AS (
  SELECT DISTINCT u.doc_id FROM u JOIN r ON r.stratum = u.stratum AND r.rule = u.rule WHERE u.score > r.cutoff
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.doc_id IS NULL AS kept
FROM s LEFT JOIN x ON x.doc_id = s.doc_id
"""
}

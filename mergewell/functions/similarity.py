"""String similarity for names: built-ins cannot express longest common subsequences cheaply, so Arrow batches do."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import scalars as S


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word or more of ``a`` at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Insertions and deletions that turn one into the other, as a share of both lengths, from 100 down."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base, l_text, r_text = " ".join(both), " ".join(left), " ".join(right)
    if not both:
        return ratio(l_text, r_text)
    return max(ratio(base, f"{base} {l_text}"), ratio(base, f"{base} {r_text}"), ratio(f"{base} {l_text}", f"{base} {r_text}"))


def initials(a: str, b: str) -> float:
    """95 less 5 for each token that the longer name has more, if every token of the shorter one is a token of the
    longer one or stands for one by its first letter, each for another; else 0.  Of equally long names the left one is the shorter."""
    x, y = a.split(), b.split()
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if not short:
        return 0.0
    rest = list(long)
    for token in short:
        taken = next((other for other in rest if token == other or len(token) == 1 and other.startswith(token)), None)
        if taken is None:
            return 0.0
        rest.remove(taken)
    return max(0.0, 95.0 - 5.0 * (len(long) - len(short)))


def _pairwise(score, left: Column, right: Column) -> Column:
    def run(a, b):
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(left, right)


def token_sort_ratio(left: Column, right: Column) -> Column:
    return _pairwise(token_sort, left, right)


def token_set_ratio(left: Column, right: Column) -> Column:
    return _pairwise(token_set, left, right)


def initials_score(left: Column, right: Column) -> Column:
    """Direction matters: see :func:`initials`."""
    return _pairwise(initials, left, right)


def name_score(left: Column, right: Column) -> Column:
    """The best of token sort, token set and initials."""
    return _pairwise(lambda a, b: max(token_sort(a, b), token_set(a, b), initials(a, b)), left, right)


def _parts(name: Column) -> Column:
    """What :func:`near_pairs` compares: tokens, one-letter tokens, first letters, lengths, letters met once and twice."""
    tokens = F.filter(F.split(name, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    one_more = lambda acc, bit: F.struct(acc["once"].bitwiseOR(bit).alias("once"), acc["twice"].bitwiseOR(acc["once"].bitwiseAND(bit)).alias("twice"))
    letters = F.filter(F.split(F.array_join(tokens, ""), ""), lambda c: c != "")
    none = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    met = F.aggregate(letters, none, lambda acc, c: one_more(acc, F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    return F.struct(
        tokens.alias("tokens"), F.filter(tokens, lambda t: F.length(t) == 1).alias("short"), F.transform(tokens, lambda t: F.substring(t, 1, 1)).alias("firsts"),
        F.length(F.array_join(tokens, " ")).alias("n"), F.length(F.array_join(F.array_distinct(tokens), " ")).alias("n_set"), met.alias("met"),
    )


#: Characters by how common they are in names, the rarest first; others count as rarer still.  Any order loses nothing.
RARE_FIRST = "qzxjkvwfpbgyumcdhlsotrniea "
#: Lengths within this factor share a class.
LENGTH_STEP = 1.25
#: Names of each side that one task sets against each other under a key.
BLOCK = 4096
#: Least score from which keys are worth it: of varied names a quarter as many rows meet by them as there are pairs at 90, nine tenths at 71.
KEYED_FLOOR = 85.0


def _elements(text: Column) -> Column:
    """A text's characters as struct(rank, c, k), the k-th of its kind, the rarest first."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))

    def numbered(v: Column) -> Column:
        nth = lambda c, i: (i - F.array_position(v, c) + 1).cast("int")
        return F.array_sort(F.transform(v, lambda c, i: F.struct((F.position(c, F.lit(RARE_FIRST)) - 8 * nth(c, i)).alias("rank"), c.alias("c"), nth(c, i).alias("k"))))

    return S.let(chars, numbered)


def _keys(parts: str, share: float, left: bool) -> Column:
    """Keys of which two names that may score ``share`` have one in common: tokens, initials, and rare characters.

    Two texts of n and m characters with a ratio of ``share`` have ``share * (n + m) / 2`` characters in
    common, so one of them stands among the rarest of either, as many as that leaves over and one more.
    Such a key holds the character, which of its kind it is, and the classes of both lengths.  Keys of tokens
    and initials are negative, those of characters are not.
    """
    low = share / (2 - share)
    length_class = lambda n: F.floor(F.log(n.cast("double")) / math.log(LENGTH_STEP)).cast("int")

    def whole(text: Column) -> Column:
        n = F.length(text)
        shortest = F.greatest(F.floor(n * low), F.lit(1))

        def against(v: Column, other: Column) -> Column:
            m = F.greatest(F.floor(F.pow(F.lit(LENGTH_STEP), other)), shortest)
            spare = F.greatest(F.size(v) - F.ceil((n + m) * (share / 2)) + 1, F.lit(0)).cast("int")
            classes = (length_class(n), other) if left else (other, length_class(n))
            return F.transform(F.slice(v, F.lit(1), spare), lambda e: F.xxhash64(e["c"], e["k"], *classes).bitwiseAND(F.lit(2**63 - 1)))

        others = F.sequence(length_class(shortest), length_class(F.ceil(n / low)))
        return S.let(_elements(text), lambda v: F.flatten(F.transform(others, lambda o: against(v, o))))

    tagged = lambda tag, part: F.transform(f"{parts}.{part}", lambda x: F.xxhash64(F.lit(tag), x).bitwiseOR(F.lit(-(2**63))))
    initials_of = (tagged("left", "short"), tagged("right", "firsts")) if left else (tagged("left", "firsts"), tagged("right", "short"))
    texts = F.array_distinct(F.array(F.array_join(f"{parts}.tokens", " "), F.array_join(F.array_distinct(f"{parts}.tokens"), " ")))
    return F.array_distinct(F.concat(tagged("token", "tokens"), *initials_of, F.flatten(F.transform(texts, whole))))


def _dealt(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` and ``b`` joined on ``key``; a key's rows go to blocks, every block of one side against every block of the other."""
    count = lambda df, x, y: df.select("key", F.lit(x).alias("x"), F.lit(y).alias("y"))
    sizes = count(a, 1, 0).union(count(b, 0, 1)).groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x > 0 and y > 0")
    sizes = sizes.select("key", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("x", "y")])
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(sizes, "key").select(*a.columns, own("l", "x").alias("i"), every("y").alias("j"))
    right = b.join(sizes, "key").select(*b.columns, every("x").alias("i"), own("r", "y").alias("j"))
    # a number of its own keeps small inputs from being scored in one task
    spark = a.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(tasks, "key", "i", "j").join(right.repartition(tasks, "key", "i", "j"), ["key", "i", "j"])


def near_pairs(left: DataFrame, right: DataFrame, floor: float, unordered: bool = False) -> DataFrame:
    """(l, r): pairs of ``left.l`` and ``right.r`` of which any of this module's scores may reach ``floor``; none that does is lost.

    Names that share a token, or of which one has another's first letter as a token, stay.  For all
    others every score is a ratio of whole names, which cannot reach the floor if their lengths differ
    too far, or if more letters stand in one only (counted up to twice in 64 classes, which is never
    more than the letters to insert and delete).  ``unordered`` keeps l < r.

    From ``KEYED_FLOOR`` on names meet by the keys of :func:`_keys` in an equi-join, and a pair counts under
    the least key that both have, so it comes out once.  Below, all pairs are looked at.  Names are
    expected to be distinct on each side; null and blank ones have no pair.
    """
    share = floor / 100 - 1e-9
    part = lambda df, name, p: df.select(name, _parts(F.col(name)).alias(p)).where(f"size({p}.tokens) > 0")
    fits = lambda n: 2 * F.least(f"a.{n}", f"b.{n}") >= share * (F.col(f"a.{n}") + F.col(f"b.{n}"))
    apart = sum((F.bit_count(F.col(f"a.met.{k}").bitwiseXOR(F.col(f"b.met.{k}"))) for k in ("once", "twice")), F.lit(0))
    repeats = (F.col("a.n") > F.col("a.n_set")) | (F.col("b.n") > F.col("b.n_set"))
    whole = (fits("n") | fits("n_set")) & (repeats | (apart <= (1 - share) * (F.col("a.n") + F.col("b.n"))))
    if floor >= KEYED_FLOOR:
        keyed = lambda df, name, p: part(df, name, p).withColumn(f"{p}_keys", _keys(p, share, p == "a")).select("*", F.explode(f"{p}_keys").alias("key"))
        met = _dealt(keyed(left, "l", "a"), keyed(right, "r", "b"))
        kept = ((F.col("key") < 0) | whole) & (F.col("key") == F.array_min(F.array_intersect("a_keys", "b_keys")))
    else:
        met = part(left.repartition(left.sparkSession.sparkContext.defaultParallelism), "l", "a").crossJoin(part(right, "r", "b"))
        initial = F.arrays_overlap("a.short", "b.firsts") | F.arrays_overlap("b.short", "a.firsts")
        kept = F.arrays_overlap("a.tokens", "b.tokens") | initial | whole
    return met.where((F.col("l") < F.col("r")) & kept if unordered else kept).select("l", "r")

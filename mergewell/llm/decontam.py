"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

Texts become words of letters and digits in lower case, and five-word shingles.  Benchmark items of N
shingles are set against document windows of N shingles (the whole document if it has fewer).  Only
windows that hold a shingle of an item of that size are looked at: no other one is similar to any.
Documents without any such shingle leave in the first scan, and only the rest is read again.

A window's fingerprint is SimHash: 12 blocks of 18 bits, each bit the majority of that bit among the
hashes of the window's shingles.  The index holds each item under every block value within 2 bits of
its own, so a look-up of a window's own 12 values meets every item within ``RADIUS`` = 35 bits of the 216
for certain, and a random pair with probability 12 * 172 / 2**18 = 0.8 %.  At a similarity of 0.8
the expected distance is 33 bits and a pair meets with probability 0.9997, as 12 blocks are tried; all that
meet are verified, whatever their distance.  Exact weighted-shingle similarity (smaller counts over larger
ones) decides at last.  Items of one to four words are one shingle, which a document must hold exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm.common import WORD_GAP, cut, if_small, let

SHINGLE, THRESHOLD = 5, 0.8
#: A fingerprint is ``WORDS`` longs of ``PER_WORD`` blocks each.
WORDS, PER_WORD, BLOCK_BITS, BLOCK_RADIUS = 4, 3, 18, 2
BLOCKS = WORDS * PER_WORD
#: Fingerprints within this distance share a block up to BLOCK_RADIUS bits for certain.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Shingles that 16-bit counters can count.
NARROW = 2**16 - 1


def plain_words(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(kept, WORD_GAP), lambda w: w != "")


def shingles_of(text: Column) -> Column:
    """array<long>: a hash of each five-word window."""

    def hashes(words: Column) -> Column:
        n = F.greatest(F.size(words) - F.lit(SHINGLE - 1), F.lit(0))
        parts = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])
        return F.transform(parts, lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(SHINGLE)]))

    return let(plain_words(text), hashes)


def _right(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def _majority(hashes: Column, salt: int, lane: int) -> Column:
    """``PER_WORD`` blocks of bits, each the majority of that bit among the salted hashes; counters of ``lane`` bits, several in a long.

    Bit g + lane * k of the hashes is counted in the k-th counter of the g-th long.  The bits are the first 14 of each 16, whatever the lane.
    """
    bits, used = PER_WORD * BLOCK_BITS, 14
    groups = used if lane == 16 else 16 + used
    mask = F.lit(sum(1 << lane * k for k in range(64 // lane)))
    zero = F.array_repeat(F.lit(0).cast("long"), groups)
    counted = F.aggregate(F.transform(hashes, lambda h: F.xxhash64(F.lit(salt), h)), zero, lambda acc, h: F.transform(acc, lambda x, g: x + _right(h, g).bitwiseAND(mask)))

    def out(c: Column) -> Column:
        def add(acc: Column, at: Column) -> Column:
            bit = at % used + 16 * F.floor(at / used).cast("int")
            n = _right(F.get(c, bit % lane), F.lit(lane) * F.floor(bit / lane).cast("int")).bitwiseAND(F.lit(2**lane - 1))
            return acc.bitwiseOR(F.when(2 * n > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), add)

    return let(counted, out)


def simhash(hashes: Column) -> Column:
    """array<long>: ``WORDS`` longs of majority bits; wider counters for more shingles than narrow ones can count."""
    of = lambda lane: F.array(*[_majority(hashes, salt, lane) for salt in range(1, WORDS + 1)])
    return F.when(F.size(hashes) <= NARROW, of(16)).otherwise(of(32))


def _blocks(fingerprint: Column) -> Column:
    """The values of all blocks in order."""
    parts = [F.shiftrightunsigned(F.get(fingerprint, w), BLOCK_BITS * b).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int") for w in range(WORDS) for b in range(PER_WORD)]
    return F.array(*parts)


def _flips() -> list[int]:
    """Every way to change up to BLOCK_RADIUS bits of a block."""
    return [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of two arrays' common values.

    Each common value counts once, by a hash set; only those that both hold repeatedly are counted one by one.
    """

    def repeated(v: Column) -> Column:
        return let(F.sort_array(v), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))

    copies = lambda v, x: F.size(v) - F.size(F.array_remove(v, x))
    more = F.aggregate(F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda acc, x: acc + F.least(copies(a, x), copies(b, x)) - 1)
    return F.size(F.array_intersect(a, b)) + F.when((F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b)), more).otherwise(0)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, n, hashes, print) of items with a five-word shingle; null and empty items match nothing.

    ``item`` is a key that is never null, as an ``item_id`` may be.
    """
    rows = benchmark.select("item_id", shingles_of(F.col("text")).alias("hashes"))
    return rows.select("item_id", F.xxhash64("item_id", "hashes").alias("item"), F.size("hashes").alias("n"), "hashes").where("n > 0").withColumn("print", simhash(F.col("hashes")))


def _windows(hits: DataFrame) -> DataFrame:
    """(d, th, runs) from hits (d, th, m, n, p): array of (s, n), start and size of the windows that hold a hit.

    A document's hits of one size are sorted; the windows whose first hit is the i-th are a range of starts.
    A document of fewer shingles than ``n`` is one window.
    """
    grouped = hits.groupBy("d", "th", "m", "n").agg(F.sort_array(F.collect_set("p")).alias("ps")).withColumn("l", F.least("m", "n"))

    def starts(p: Column, i: Column) -> Column:
        low = F.greatest(F.lit(0), p - F.col("l") + 1, F.when(i > 0, F.get(F.col("ps"), i - 1) + 1).otherwise(F.lit(0)))
        high = F.least(p, F.col("m") - F.col("l"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    runs = F.flatten(F.transform(F.col("ps"), starts))
    rows = grouped.select("d", "th", F.transform(runs, lambda s: F.struct(s.alias("s"), F.col("n").alias("n"))).alias("runs"))
    return rows.where(F.size("runs") > 0).groupBy("d", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"))


#: So many distinct item shingles are looked up as a set inside the scan; more of them are joined.
SET_SHINGLES = 100_000


def _holders(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """The documents (doc_id, text) that hold a shingle of an item: the few whose texts are read again."""
    wanted = sized.select("h").distinct()
    shingled = docs.withColumn("hs", shingles_of(F.col("text")))
    if wanted.limit(SET_SHINGLES + 1).count() <= SET_SHINGLES:
        known = ",".join(str(r["h"]) + "L" for r in wanted.collect())
        return cut(shingled.where(f"exists(hs, x -> x in ({known}))" if known else "false").select("doc_id", "text"), "holders")
    found = shingled.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_th"), F.explode("hs").alias("h")).join(wanted, "h").select("_d", "_th").distinct()
    return cut(docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_th")), "left_semi"), "holders")


def _opened(docs: DataFrame, where: DataFrame) -> DataFrame:
    """(doc_id, th, s, n, w): the shingles of each window in ``where`` (d, th, runs)."""
    keyed = if_small(where.withColumnsRenamed({"d": "_d", "th": "_th"}))
    held = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(keyed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")))
    held = held.select("doc_id", "th", shingles_of(F.col("text")).alias("hs"), "runs")
    cutout = F.transform("runs", lambda r: F.struct(r["s"].alias("s"), r["n"].alias("n"), F.slice(F.col("hs"), r["s"] + 1, r["n"]).alias("w")))
    return held.select("doc_id", "th", F.explode(cutout).alias("x")).select("doc_id", "th", "x.s", "x.n", "x.w")


def _short(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, th, item_id, s, similarity) of items of one to four words; None where there are none."""
    few = benchmark.select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w").between(1, SHINGLE - 1))
    items = cut(few.select("item_id", F.size("w").alias("k"), F.concat_ws(" ", "w").alias("words")).distinct(), "short-items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    if not sizes:
        return None

    def grams(words: Column) -> Column:
        of = lambda k: F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda s: F.struct(s.alias("s"), F.array_join(F.slice(words, s + 1, F.lit(k)), " ").alias("words")))
        return F.flatten(F.array(*[F.when(F.size(words) >= k, of(k)).otherwise(F.array().cast("array<struct<s:int,words:string>>")) for k in sizes]))

    spread = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(let(plain_words(F.col("text")), grams)).alias("x")).select("doc_id", "th", "x.s", "x.words")
    return spread.join(if_small(items.select("item_id", "words")), "words").groupBy("doc_id", "th", "item_id").agg(F.min("s").alias("s")).select("doc_id", "th", "item_id", "s", F.lit(1.0).alias("similarity"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, start, similarity): each document's best window for each item that it holds.

    ``start`` counts words of letters and digits; among equal windows the first counts.  Null and
    empty texts hold nothing, rows equal in doc_id and text are one document, and an empty
    benchmark or table gives an empty result.  Items with equal texts are all reported; of items
    with one id, null among them, the best window of any.
    """
    every = docs.select("doc_id", "text")
    items = cut(items_of(benchmark), "items")
    sized = cut(items.select("n", F.explode(F.array_distinct("hashes")).alias("h")).distinct(), "item-shingles")
    docs = _holders(every, sized)
    shingled = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), shingles_of(F.col("text")).alias("hs"))
    spread = shingled.select("d", "th", F.size("hs").alias("m"), F.posexplode("hs").alias("p", "h"))
    hits = spread.join(if_small(sized), "h").select("d", "th", "m", "n", "p")
    where = cut(_windows(hits), "windows")
    prints = cut(_opened(docs, where).select("doc_id", "th", "s", "n", simhash(F.col("w")).alias("print")), "prints")
    probes = prints.select("n", "print").distinct().select("n", "print", F.posexplode(_blocks(F.col("print"))).alias("block", "value"))
    flips = F.array(*[F.lit(f) for f in _flips()])
    index = items.select("n", "item", F.posexplode(_blocks(F.col("print"))).alias("block", "own"))
    index = cut(index.select("n", "item", "block", F.explode(F.transform(flips, lambda f: F.col("own").bitwiseXOR(f))).alias("value")).distinct(), "index")
    near = cut(probes.join(if_small(index), ["n", "block", "value"]).select("n", "print", "item").distinct(), "near")
    likely = prints.join(if_small(near.select("n", "print").distinct()), ["n", "print"], "left_semi")
    places = likely.groupBy(F.col("doc_id").alias("d"), "th").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    key = [F.xxhash64(F.lit(k), "w").alias(f"k{k}") for k in (1, 2)]
    opened = cut(_opened(docs, cut(places, "places")).select("doc_id", "th", "s", "n", "w", *key, simhash(F.col("w")).alias("print")), "opened")
    distinct = opened.groupBy("n", "k1", "k2").agg(F.first("w").alias("w"), F.first("print").alias("print"))
    both = distinct.join(if_small(near), ["n", "print"]).join(if_small(items.select("item_id", "item", "n", "hashes").distinct()), ["item", "n"])
    shared = overlap(F.col("w"), F.col("hashes"))
    scored = both.select("n", "k1", "k2", "item_id", let(shared, lambda o: o / (F.size("w") + F.size("hashes") - o)).alias("similarity"))
    passed = cut(scored.where(F.col("similarity") >= THRESHOLD), "passed")
    found = opened.select("doc_id", "th", "s", "n", "k1", "k2").join(if_small(passed), ["n", "k1", "k2"]).select("doc_id", "th", "item_id", "s", "similarity")
    short = _short(every, benchmark)
    found = found if short is None else found.union(short)
    best = found.groupBy("doc_id", "th", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("x"), F.col("s").alias("s"))).alias("b"))
    return best.select("doc_id", "th", "item_id", F.col("b.s").cast("long").alias("start"), (-F.col("b.x")).alias("similarity"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents of (doc_id, text, ...) that hold no benchmark item; repeated rows stay or go together, null texts stay."""
    leaks = if_small(cut(find(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("th").alias("_th")).distinct(), "leaks"))
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_th")), "left_anti")


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole texts of ``documents`` hold which items of ``benchmark``; edge cases as in :func:`find`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "start", "similarity")


QUERIES = {"op8_simhash_windows": op8_simhash_windows}
ORACLE_SQL: dict[str, str] = {}

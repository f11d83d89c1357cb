"""Personal data: exact rules, then contextual extraction bootstrapped from what they find.

The rules give spans of e-mail addresses, IP addresses, card and phone numbers.  These entities are
the seeds, and so are digests in lower case (32, 40 or 64 hexadecimal digits), as keys and tokens are
written; the latter are reported only where their context speaks for them.  All other tokens with a
digit or an at sign are unseen instances.  Around an instance stand its lexical patterns: the two
words before, the word before and the one behind, and the word before with the instance's shape.

On the graph of patterns and instances, a pattern's score for a kind is the share of its distinct
instances that are of the kind, each by its score, with ``PRIOR`` instances more that are not; an
instance's score for a kind is the chance that not all of its confident patterns are wrong.  The two
are taken in turn until no score moves.  Scores only grow, so this ends.  Unseen instances that
confident patterns make confident are added, under the kind that scores best.

All of it is DataFrame operations, each linear in a text's length.  A pattern of so few distinct
instances that it can never be confident leaves the graph beforehand, which loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm.common import cut, discard, if_small, let, running_sum, running_top

KINDS = ("email", "ip", "card", "phone")
#: Names of all kinds of spans: the rules' own, then what only context found.
NAMES = (*KINDS, "email_like", "ip_like", "card_like", "phone_like", "secret")
SECRET = len(KINDS)
#: Possessive forms of the contract's patterns: a run is entered at its start only, so no text makes them slow.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_SECRET_SEED = r"^(?=.*[0-9])(?=.*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Score from which patterns and instances count, instances added to each pattern, and the least move that counts.
CONFIDENT, PRIOR, MOVE = 0.8, 1.0, 0.01
#: Characters on either side of an instance in which its context words are looked for.
CONTEXT_CHARS = 80
#: Stands where a rule's span was when the rest is read.
_MASK = "\ue000"


def _found(text: Column, pattern: str) -> Column:
    """array<struct(start, end, s, before, after)> of all matches; offsets in code points, end exclusive.

    The pieces between matches give the offsets: a match starts behind all pieces and matches before it.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def rows(g: Column, s: Column, ends: Column) -> Column:
        def one(m, k):
            end = F.get(ends, k)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("s"), F.get(g, k).alias("before"), F.get(g, k + 1).alias("after"))

        return F.transform(s, one)

    def placed(p: Column) -> Column:
        sizes = F.transform(p["s"], lambda m, k: F.length(F.get(p["g"], k)) + F.length(m))
        return let(running_sum(sizes), lambda ends: rows(p["g"], p["s"], ends))

    return let(F.struct(gaps.alias("g"), hits.alias("s")), placed)


def _luhn(digits: Column) -> Column:
    rev = F.reverse(digits)

    def add(acc, i):
        d = F.substring(rev, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = F.translate(s, " -", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(s, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,end:int,kind:int>>"
_SEEN = "array<struct<start:int,end:int,kind:int,token:string,patterns:array<string>>>"


def _word(gap: Column, side: str, k: int) -> Column:
    """The k-th word (from 1) of a gap's ``CONTEXT_CHARS`` next to an instance, lower case; ``#`` for none,
    an instance or a rule's span."""
    near = F.right(gap, F.lit(CONTEXT_CHARS)) if side == "before" else F.left(gap, F.lit(CONTEXT_CHARS))
    words = F.filter(F.split(F.lower(near), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = F.get(words, F.size(words) - k) if side == "before" else F.get(words, F.lit(k - 1))
    return F.when(w.isNull() | w.rlike(f"[0-9@{_MASK}]"), F.lit("#")).otherwise(w)


def _shape(token: Column) -> Column:
    """Digits as 9, letters as a, stretches of both as x; the rest as it is."""
    mixed = F.regexp_replace(token, r"[A-Za-z]*[0-9]+[A-Za-z][A-Za-z0-9]*|[A-Za-z]+[0-9][A-Za-z0-9]*", "x")
    return F.regexp_replace(F.regexp_replace(mixed, "[0-9]+", "9"), r"[A-Za-z]{2,}|[A-Wa-wY-Zyz]", "a")


def _patterns(token: Column, before: Column, after: Column) -> Column:
    def made(w: Column) -> Column:
        left = F.concat(F.lit("L\t"), w["w2"], F.lit("\t"), w["w1"])
        both = F.concat(F.lit("B\t"), w["w1"], F.lit("\t"), w["r1"])
        shaped = F.concat(F.lit("S\t"), w["w1"], F.lit("\t"), _shape(token))
        return F.filter(F.array(left, both, shaped), lambda p: ~p.contains("\t#"))

    return let(F.struct(_word(before, "before", 2).alias("w2"), _word(before, "before", 1).alias("w1"), _word(after, "after", 1).alias("r1")), made)


def _seeds(text: Column) -> Column:
    """The rules' entities in order of kind: struct(start, end, kind, token, patterns)."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(_found(text, PATTERNS[kind]), lambda m: _valid(kind, m["s"]))
        rows = F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("kind"), m["s"].alias("token"), _patterns(m["s"], m["before"], m["after"]).alias("patterns")))
        needs = text.rlike("[0-9]") if NEEDS[kind] is None else text.contains(NEEDS[kind])
        return F.when(needs, rows).otherwise(F.array().cast(_SEEN))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _masked(text: Column) -> Column:
    """The text with the rules' spans blanked, kind by kind, each on what the ones before left; no offset moves."""

    def blank(kind: str):
        def over(t: Column) -> Column:
            gaps, hits = F.split(t, PATTERNS[kind], -1), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))
            mask = lambda m: F.concat(F.lit(" "), F.repeat(F.lit(_MASK), F.length(m) - 2), F.lit(" "))
            kept = F.transform(hits, lambda m: F.when(_valid(kind, m), mask(m)).otherwise(m))
            return F.array_join(F.flatten(F.zip_with(gaps, kept, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")

        return over

    for kind in KINDS:
        text = let(text, blank(kind))
    return text


def _ordered(spans: Column) -> Column:
    by_kind = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(by_kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _instances(rest: Column) -> Column:
    """Tokens with a digit or an at sign of what the rules left: struct(start, end, kind, token, patterns).

    Stops and brackets at a token's ends are no part of it; ``kind`` is that of digests, else null.
    """

    def one(m: Column) -> Column:
        head = F.length(F.regexp_extract(m["s"], r"^([(\[{\"'<]*+)", 1))
        core = F.regexp_replace(F.substring(m["s"], head + 1, F.length(m["s"])), r"[^\p{L}\p{N}@]++$", "")
        start = m["start"] + head
        kind = F.when(core.rlike(_SECRET_SEED), F.lit(SECRET))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), kind.alias("kind"), core.alias("token"), _patterns(core, m["before"], m["after"]).alias("patterns"))

    return F.filter(F.transform(_found(rest, _TOKEN), one), lambda x: x["end"] > x["start"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, th, seeds, seen): each row's rule entities and its other instances; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SEEN)

    def both(s: Column) -> Column:
        rest = F.when(F.size(s) > 0, _masked(text)).otherwise(text)
        return F.struct(s.alias("seeds"), let(rest, _instances).cast(_SEEN).alias("seen"))

    rows = F.when(text.rlike("[0-9@]"), let(_seeds(text).cast(_SEEN), both)).otherwise(F.struct(none.alias("seeds"), none.alias("seen")))
    return docs.select("doc_id", F.xxhash64("text").alias("th"), rows.alias("r")).select("doc_id", "th", "r.seeds", "r.seen")


def confident_tokens(seen: DataFrame, confident: float = CONFIDENT, prior: float = PRIOR) -> DataFrame:
    """(token, kind, score) of instances that context makes identifiers, from rows of (token, kind, pattern).

    ``kind`` is null where no rule names one.  Seeds come out only where a confident pattern holds them.
    Each round sums the graph's edges by pattern, then by token; both sums start map-side.
    """
    edges = cut(seen.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "edges")
    # n instances of score 1 give n / (n + prior): with fewer than this many a pattern can never be confident
    least = math.ceil(confident * prior / (1 - confident) - 1e-9)
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    graph = cut(edges.join(sizes, "pattern").select("pattern", "n", "token", "kind"), "graph")
    discard(edges)
    seeds = cut(graph.where("kind is not null").select("token", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    links = graph.select("pattern", "n", "token")
    heard = None
    while True:
        scores = seeds if heard is None else seeds.union(heard.join(seeds, ["token", "kind"], "left_anti").select("token", "kind", "score"))
        patterns = links.join(scores, "token").groupBy("pattern", "kind", "n").agg(F.sum("score").alias("s"))
        patterns = patterns.select("pattern", "kind", (F.col("s") / (F.col("n") + F.lit(prior))).alias("c")).where(F.col("c") >= confident - 1e-9)
        fresh = links.join(patterns, "pattern").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(0.999999)))))).alias("score"))
        fresh = cut(fresh, "scores")
        old = fresh.select("token", "kind", F.lit(0.0).alias("old")).limit(0) if heard is None else heard.withColumnRenamed("score", "old")
        moved = fresh.join(old, ["token", "kind"], "left").where(F.col("score") > F.coalesce("old", F.lit(0.0)) + MOVE).limit(1).count()
        if heard is not None:
            discard(heard)
        heard = fresh
        if not moved:
            break
    best = heard.where(F.col("score") >= confident - 1e-9).groupBy("token").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
    out = cut(best.select("token", (-F.col("b.col2")).alias("kind"), F.col("b.score").alias("score")), "tokens")
    for t in (graph, seeds, heard):
        discard(t)
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, spans) of each row of (doc_id, text), whole texts; null text is empty.

    ``base`` are the rules' spans and ``spans`` all of them, arrays of struct(start, end, kind);
    kinds number ``NAMES``.  A token counts as discovered in every place where it stands outside the
    rules' spans, whatever surrounds it there.  Very long texts take time in proportion to their
    length.  Rows equal in doc_id and text are treated alike, repeated rows each give a row, an
    empty table gives an empty result; ties between kinds go to the first of ``NAMES``.
    """
    rows = cut(scan(docs), "pii")
    both = rows.select(F.explode(F.concat("seeds", "seen")).alias("x")).select("x.token", "x.kind", F.explode("x.patterns").alias("pattern"))
    new = confident_tokens(both)
    seen = rows.select("doc_id", "th", F.explode("seen").alias("x")).select("doc_id", "th", "x.start", "x.end", "x.token")
    kind = F.when(F.col("kind") == SECRET, F.lit(len(NAMES) - 1)).otherwise(F.col("kind") + len(KINDS)).cast("int")
    extra = seen.join(if_small(new.select("token", "kind")), "token").select("doc_id", "th", F.struct("start", "end", kind.alias("kind")).alias("s"))
    extra = extra.groupBy("doc_id", "th").agg(F.collect_set("s").alias("more")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    out = rows.select("doc_id", "th", _ordered(F.col("seeds")).alias("base")).join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th").eqNullSafe(F.col("_t"))), "left")
    return out.select("doc_id", "th", "base", _ordered(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents of (doc_id, text, ...) with each span replaced by its kind in brackets; overlaps give one, the first's.

    A column ``n_spans`` of replaced stretches is added, or replaced if there is one.  Null texts stay null.
    """
    found = find(docs).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("spans").alias("_spans")).dropDuplicates(["_d", "_t"])
    names = [c for c in docs.columns if c != "n_spans"]
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left")
    label = F.array(*[F.lit(f"[{k}]") for k in NAMES])

    def heads(spans: Column, tops: Column) -> Column:
        """The first span of each stretch of overlapping ones, with where the stretch before ends and where this one does."""
        starts = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | (F.get(spans, k)["start"] >= F.get(tops, k - 1)))
        return let(starts, lambda h: F.transform(h, lambda k, j: F.struct(
            F.when(k > 0, F.get(tops, k - 1)).otherwise(F.lit(0)).alias("from"), F.get(spans, k)["start"].alias("start"), F.get(spans, k)["kind"].alias("kind"),
            F.when(j + 1 < F.size(h), F.get(tops, F.get(h, j + 1) - 1)).otherwise(F.get(tops, F.size(tops) - 1)).alias("end"))))

    def written(hs: Column) -> Column:
        def text(chars: Column) -> Column:
            pieces = F.transform(hs, lambda h: F.concat(F.array_join(F.slice(chars, h["from"] + 1, h["start"] - h["from"]), ""), F.get(label, h["kind"])))
            end = F.get(hs, F.size(hs) - 1)["end"]
            return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(chars, end + 1, F.greatest(F.size(chars) - end, F.lit(0))), ""))

        return F.struct(let(F.split("text", ""), text).alias("out"), F.size(hs).cast("long").alias("n"))

    done = let(F.col("_spans"), lambda s: let(running_top(F.transform(s, lambda x: x["end"])), lambda tops: let(heads(s, tops), written)))
    out = out.withColumn("_done", F.when(F.size("_spans") > 0, done))
    return out.withColumn("text", F.coalesce("_done.out", "text")).withColumn("n_spans", F.coalesce("_done.n", F.lit(0).cast("long"))).select(*names, "n_spans")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``: counts and digest of the rules' spans, and all spans.

    Null and empty texts have no spans and the digest of nothing.  Repeated rows each give a row; an
    empty table gives none; other columns are not read.
    """
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


QUERIES = {"op9_bootstrapped_pii": op9_bootstrapped_pii}
ORACLE_SQL: dict[str, str] = {}

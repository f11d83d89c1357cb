"""Which pairs of records are one person: prioritized rules as joins, the first that holds wins.

Rules on shared keys are equi-joins on exploded keys.  Within a key's group every record is
joined to the group's first one only, which connects the group with a row a record, so a key
that very many records share costs no square; pairs proper come from ``all_pairs``.  Rules on
similarity set blocks of records with like names against each other, every block against every
other, by :mod:`name_blocks`; :func:`linked` leaves out blocks that hang together already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import name_blocks, similarity
from mergewell.functions import scalars as S
from mergewell.operators.clustering import checkpointed, components

NAME, NAME_COMPANY, NAME_SKILLS = THRESHOLDS = 90.0, 85.0, 80.0
#: Records of a block, about.
BLOCK = 2048
#: Blocks of either side that a task sets against each other, at most; of those so many are open at a time.
TILE, OPEN = 32, 16
SIMILAR = {6: "Name similarity", 7: "Name and company", 8: "Name and skills"}


def urls(host: str) -> Column:
    """URL keys with a host's name in them: links, the source's own, and raw values of URL fields."""
    values = F.transform(F.filter("raw_values", lambda x: F.lower(x["field_name"]).rlike("url|link")), lambda x: x["value"])
    opened = F.transform(values, lambda v: F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(F.regexp_replace(v, r'^"|"$', ""))))
    found = F.concat(F.coalesce("links", F.array()), F.array("source.source_uri"), F.coalesce(F.flatten(opened), F.array()))
    return F.array_distinct(F.filter(F.transform(found, S.url_key), lambda x: x.contains(host)))


def email_keys() -> Column:
    return F.array_distinct(F.filter(F.transform("emails", lambda x: S.fold(S.strip_ws(x))), lambda x: x != ""))


def phone_keys() -> Column:
    return F.array_distinct(F.filter(F.transform("phones", S.phone_key), lambda x: x.isNotNull()))


def skill_keys() -> Column:
    return F.array_distinct(F.transform("skills", lambda x: S.fold(S.strip_ws(x))))


def companies() -> Column:
    """First of company, employer, organization, company_name of each entry, as name keys."""
    at = lambda x: F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("company", "employer", "organization", "company_name")])
    return F.filter(F.transform("experience", lambda x: S.name_key(at(x))), lambda x: x != "")


#: (priority, confidence, reason, keys) of the rules on shared keys.
KEY_RULES = ((1, 1.0, "Email matched", email_keys), (2, 0.98, "Phone number matched", phone_keys), (3, 0.94, "GitHub URL matched", lambda: urls("github.com")), (9, 0.96, "LinkedIn URL matched", lambda: urls("linkedin.com")))


def keyed(records: DataFrame, keys: Column) -> DataFrame:
    return records.select("record_idx", F.explode(keys).alias("key"))


def star(keys: DataFrame) -> DataFrame:
    """(left, right) that connect each key's records: every later one with the first."""
    first = keys.groupBy("key").agg(F.min("record_idx").alias("right"), F.max("record_idx").alias("last")).where("right < last")
    return keys.join(first, "key").where("record_idx > right").select(F.col("record_idx").alias("left"), "right")


def all_pairs(keys: DataFrame) -> DataFrame:
    """(left, right, key): every pair that shares a key, the later record left; for keys that few share."""
    return keys.alias("l").join(keys.alias("r"), "key").where("l.record_idx > r.record_idx").select(F.col("l.record_idx").alias("left"), F.col("r.record_idx").alias("right"), "key")


def _tagged(pairs: DataFrame, priority: int, confidence: Column, reason: Column) -> DataFrame:
    return pairs.select("left", "right", F.lit(priority).alias("rule"), confidence.alias("confidence"), reason.alias("reason"))


def rule_keys(records: DataFrame) -> DataFrame:
    """(record_idx, rule, key) of every rule on shared keys, worked out once and written."""
    rules = [F.transform(keys(), _ruled(priority)) for priority, _, _, keys in KEY_RULES]
    return checkpointed(records.select("record_idx", F.explode(F.concat(*[F.coalesce(r, F.array()) for r in rules])).alias("k")).select("record_idx", "k.rule", "k.key"))


def _ruled(priority: int):
    return lambda k: F.struct(F.lit(priority).alias("rule"), k.alias("key"))


def key_pairs(keys: DataFrame, complete: bool = False) -> DataFrame:
    """(left, right) by any rule of :func:`rule_keys`: of each key every later record with the first, or with ``complete`` all pairs."""
    by = keys.select("record_idx", F.struct("rule", "key").alias("key"))
    return (all_pairs if complete else star)(by).select("left", "right").distinct()


def first_rules(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, rule, confidence, reason): the first rule of :func:`rule_keys` that holds for each pair."""
    of = lambda side: keys.select(F.col("record_idx").alias(side), "rule", "key")
    shared = pairs.join(of("left"), "left").join(of("right"), ["right", "rule", "key"])
    first = shared.groupBy("left", "right").agg(F.min(F.struct("rule", "key")).alias("m"))
    return _told(first.select("left", "right", "m.rule", F.lit(0.0).alias("score"), "m.key"))


def _told(found: DataFrame) -> DataFrame:
    """Confidence and reason of (left, right, rule, score, key)."""
    table = lambda k: F.element_at(F.create_map(*[x for r in KEY_RULES for x in (F.lit(r[0]), F.lit(r[k]))]), F.col("rule"))
    by_key = F.when(F.col("rule") == 1, F.concat(table(2), F.lit(": "), F.col("key"))).otherwise(table(2))
    reason, confidence = by_key, table(1)
    for rule, what in SIMILAR.items():
        reason = F.when(F.col("rule") == rule, F.format_string(f"{what} matched: %.1f", F.col("score"))).otherwise(reason)
    confidence = F.when(F.col("rule").isin(*SIMILAR), F.round(F.col("score") / 100, 4)).otherwise(confidence)
    return found.select("left", "right", "rule", confidence.alias("confidence"), reason.alias("reason"))


def key_matches(records: DataFrame, complete: bool = False) -> DataFrame:
    """(left, right, rule, confidence, reason) of the rules on shared keys."""
    keys = rule_keys(records)
    return first_rules(keys, key_pairs(keys, complete))


def similar_names(names: DataFrame, floor: float, sort: bool) -> DataFrame:
    """(l, r, s): every ordered pair of different names that scores ``floor`` or more; with ``sort`` by token sort too.

    Only initials depend on the order, so a pair is scored once and stands both ways.
    """
    pairs = similarity.near_pairs(names.select(F.col("name").alias("l")), names.select(F.col("name").alias("r")), floor, unordered=True)
    alike = similarity.token_set_ratio(F.col("l"), F.col("r"))
    alike = F.greatest(alike, similarity.token_sort_ratio(F.col("l"), F.col("r"))) if sort else alike
    scored = pairs.select("l", "r", alike.alias("s"), similarity.initials_score(F.col("l"), F.col("r")).alias("x"), similarity.initials_score(F.col("r"), F.col("l")).alias("y"))
    way = lambda a, b, x: F.struct(F.col(a).alias("l"), F.col(b).alias("r"), F.greatest("s", x).alias("s"))
    return scored.select(F.explode(F.array(way("l", "r", "x"), way("r", "l", "y"))).alias("p")).select("p.*").where(F.col("s") >= floor)


def name_matches(records: DataFrame, threshold: float = NAME) -> DataFrame:
    """Rule 6 over distinct name keys; equal names connect by their first record."""
    named = records.select("record_idx", S.name_key(F.col("full_name")).alias("name")).where("full_name is not null")
    equal = star(named.withColumnRenamed("name", "key")).withColumn("s", F.lit(100.0))
    distinct = named.groupBy("name").agg(F.min("record_idx").alias("first"), F.max("record_idx").alias("last"))
    scored = similar_names(distinct.where("name <> ''"), threshold, sort=True)
    # the later record is the left one: any record of l against the first of r, where one comes later
    near = scored.join(distinct.select(F.col("name").alias("l"), F.col("last").alias("left")), "l").join(distinct.select(F.col("name").alias("r"), F.col("first").alias("right")), "r").where("left > right")
    pairs = equal.select("left", "right", "s").union(near.select("left", "right", "s"))
    return _tagged(pairs, 6, F.round(F.col("s") / 100, 4), F.format_string("Name similarity matched: %.1f", F.col("s")))


def _blocks(records: DataFrame, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with a name in blocks of like names: (block, blob), and (record_idx, block).  ``keys`` are those that two records share."""
    named = records.where("full_name is not null").select("record_idx", S.name_key(F.col("full_name")).alias("name"), companies().alias("companies"), skill_keys().alias("skills"))
    ends = named.groupBy("name").agg(F.min("record_idx").alias("first"), F.max("record_idx").alias("last"))
    rows = named.join(ends, "name")
    if keys is None:
        rows = rows.withColumn("keys", F.lit(None).cast("array<struct<rule:int,key:string,first:bigint>>"))
    else:
        first = keys.groupBy("rule", "key").agg(F.min("record_idx").alias("first"), F.max("record_idx").alias("to")).where("first < to").drop("to")
        held = keys.join(first, ["rule", "key"]).groupBy("record_idx").agg(F.collect_list(F.struct("rule", "key", "first")).alias("keys"))
        rows = rows.join(held, "record_idx", "left")
    packed = _packed(rows.select("record_idx", "name", "first", "last", "companies", "skills", "keys"), max(1, -(-named.count() // BLOCK)))
    return packed.select("block", "blob"), packed.select("block", F.explode("members").alias("record_idx"))


def _packed(rows: DataFrame, count: int) -> DataFrame:
    """(block, blob, members): rows in about ``count`` blocks by name and record, written, as recomputed blocks might have other bounds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for b in held:
                    writer.write_batch(b)
            ids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            members = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary()), members], names=["block", "blob", "members"])

    return checkpointed(rows.repartitionByRange(count, "name", "record_idx").mapInArrow(pack, "block int, blob binary, members array<long>"))


def _against(blocks: DataFrame, pairs: DataFrame, run, schema: str, tile: int | None = None) -> DataFrame:
    """``run`` over cells, block -> row, in which the blocks of each pair (i, j) of ``pairs`` meet; ``mates`` of a row are its j's there.

    A cell holds the pairs of up to ``TILE`` blocks with as many others, so a blob goes to a task once for all of them.
    With ``tile`` fewer, where few pairs are looked at.
    """
    spark = blocks.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    count = blocks.count()
    tile = max(1, min(tile or TILE, int(count / (2 * tasks) ** 0.5)))
    sides = -(-count // tile)
    at = lambda c: F.floor(F.col(c) / tile).cast("int").alias(f"c{c}")
    entry = lambda block, mate: F.struct(F.col(block).alias("block"), mate.cast("int").alias("mate"))
    held = pairs.select(at("i"), at("j"), F.explode(F.array(entry("i", F.col("j")), entry("j", F.lit(None)))).alias("e"))
    held = held.groupBy("ci", "cj", "e.block").agg(F.collect_list("e.mate").alias("mates"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cell = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                here = row["ci"].as_py(), row["cj"].as_py()
                if here != place:
                    yield from run(cell)
                    place, cell = here, {}
                cell[row["block"].as_py()] = row
        yield from run(cell)

    dealt = held.join(blocks, "block").repartition(max(tasks, sides * (sides + 1) // 16), "ci", "cj").sortWithinPartitions("ci", "cj", "block")
    return dealt.mapInArrow(cells, schema)


def _met(cell: dict) -> Iterator[tuple[int, int]]:
    """The pairs of a cell, in an order in which few blocks need to be open at a time."""
    yield from sorted(((i, j) for i, row in cell.items() for j in row["mates"].as_py()), key=lambda p: (p[0] // (OPEN // 2), p[1] // (OPEN // 2), p))


def _opened(cache: dict, cell: dict, number: int) -> name_blocks.Block:
    """A block, kept while the next ones need it."""
    if number not in cache:
        while len(cache) >= OPEN:
            del cache[next(iter(cache))]
        cache[number] = name_blocks.Block(pa.ipc.open_stream(cell[number]["blob"].as_py()).read_all())
    return cache[number]


def _pairs_of(blocks: DataFrame) -> DataFrame:
    of = lambda c: blocks.select(F.col("block").alias(c))
    return of("i").crossJoin(of("j")).where("i <= j")


def _ordered(a: name_blocks.Block, b: name_blocks.Block, x, y) -> list[pa.Array]:
    """The later record of each pair and the earlier one."""
    p, q = a.idx[x], b.idx[y]
    return [pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))]


def _named_matches(blocks: DataFrame, complete: bool) -> DataFrame:
    """(left, right, rule, score, key) of pairs of records that both have a name."""

    def run(cell: dict) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for i, j in _met(cell):
            a, b = _opened(cache, cell, i), _opened(cache, cell, j)
            for x, y, rule, score, key in name_blocks.found_pairs(a, b, i == j, THRESHOLDS, complete=complete):
                columns = [*_ordered(a, b, x, y), pa.array(rule.astype(np.int32)), pa.array(score), pa.array(key, pa.string()) if key else pa.nulls(len(x), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["left", "right", "rule", "score", "key"])

    return _against(blocks, _pairs_of(blocks), run, "left long, right long, rule int, score double, key string")


def scored_names(names: DataFrame) -> DataFrame:
    """(left, right, score): every pair of (record_idx, name) by different indexes, the lesser one left, and how alike the names are.

    Names are name keys, never null.  Blocks are scored as for matches, but no pair is left out, so rows grow with the square.
    """
    none = {"first": "bigint", "last": "bigint", "companies": "array<string>", "skills": "array<string>", "keys": "array<struct<rule:int,key:string,first:bigint>>"}
    rows = names.where("record_idx is not null").select("record_idx", "name", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    blocks = _packed(rows, max(1, -(-rows.count() // BLOCK))).select("block", "blob")

    def run(cell: dict) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for i, j in _met(cell):
            a, b = _opened(cache, cell, i), _opened(cache, cell, j)
            for idx, offsets, others, scores in name_blocks.scored_pairs(a, b, i == j):
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)) for values in (others, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(idx), *lists], names=["idx", "others", "scores"])

    # a row a record of a block, as rows made by Spark are cheaper than rows from Python
    each = _against(blocks, _pairs_of(blocks), run, "idx long, others array<long>, scores array<double>").select("idx", "others", F.posexplode("scores").alias("at", "score"))
    other = F.get("others", F.col("at"))
    return each.select(F.least("idx", other).alias("left"), F.greatest("idx", other).alias("right"), "score")


def _stars(blocks: DataFrame, pairs: DataFrame, tile: int | None = None) -> DataFrame:
    """(left, right): of each pair of blocks each label and the least one that rules 6 to 8 connect it with.

    A record's label is itself, or what ``ids`` and ``labels`` of its block say: records of the same label count as connected,
    and no pair of them is looked at, nor of those that pairs before in the same cell connected.  Stars keep the rounds of
    :func:`components` few, where chains of matches would not.
    """

    def run(cell: dict) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        known = {n: tuple(row[c].values.to_numpy() for c in ("ids", "labels")) for n, row in cell.items() if "labels" in row}
        distinct = {n: np.unique(labels).tolist() for n, (_, labels) in known.items()}

        def labels(block: name_blocks.Block, number: int) -> np.ndarray:
            own = known[number][1][np.searchsorted(known[number][0], block.idx)] if known else block.idx
            values, at = np.unique(own, return_inverse=True)
            return np.array([top(v) for v in values.tolist()], dtype=np.int64)[at]

        def compared(a: name_blocks.Block, i: int, b: name_blocks.Block, j: int) -> pa.RecordBatch:
            groups = name_blocks.Groups(labels(a, i), labels(b, j))
            before = np.concatenate((groups.a, groups.b))
            # a record that is in both has one label, so it is no pair
            for x, y, *_ in name_blocks.found_pairs(a, b, False, THRESHOLDS, labels=[groups.a, groups.b], with_keys=False):
                groups.add(x, y)
            links = np.unique(np.stack((before, np.concatenate((groups.a, groups.b)))), axis=1)
            left, right = links[:, links[0] != links[1]]
            parent.update(zip(left.tolist(), right.tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["left", "right"])

        for i, j in _met(cell):
            if known and len({top(v) for n in (i, j) for v in distinct[n]}) == 1:
                continue
            a, b = _opened(cache, cell, i), _opened(cache, cell, j)
            # some names of one side connect most records; then those outside the largest group, of either side, meet all of the other
            yield compared(a, i, b.part(b.idx[:: max(1, len(b.idx) // name_blocks.CHUNK)]), j)
            values, counts = np.unique(np.concatenate((labels(a, i), labels(b, j))), return_counts=True)
            most = int(values[counts.argmax()])
            for whole, m, other, n in ((a, i, b, j), (b, j, a, i))[: 1 if i == j else 2]:
                rest = other.idx[labels(other, n) != top(most)]
                if len(rest):
                    yield compared(whole, m, other.part(rest), n)

    return _against(blocks, pairs, run, "left long, right long", tile)


def _labelled(members: DataFrame, known: DataFrame) -> DataFrame:
    """(block, ids, labels, low, high): each block's records in order, their labels, the least and the greatest label."""
    held = members.join(known, "record_idx").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("record_idx", "cluster_id"))).alias("l"), F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high"))
    return checkpointed(held.select("block", F.col("l.record_idx").alias("ids"), F.col("l.cluster_id").alias("labels"), "low", "high"))


def linked(records: DataFrame) -> DataFrame:
    """(left, right), each record or group with its least, that connect the same records as :func:`matches` by all rules, without a row for each match.

    Keys and names of the same block connect records first, then names of blocks at distances of powers of two.  Two blocks
    whose records all hang together by then have nothing to add and are not compared; all others are, but only records that are still apart.
    """
    keys = rule_keys(records)
    blocks, members = _blocks(records)
    near = key_pairs(keys).union(_stars(blocks, blocks.select(F.col("block").alias("i"), F.col("block").alias("j")), 1))
    known = checkpointed(components(records, near))
    side = lambda labels, i: labels.select(F.col("block").alias(i), F.col("low").alias(f"low_{i}"), F.col("high").alias(f"high_{i}"))
    for some in (F.bit_count(F.col("j") - F.col("i")) == 1, F.lit(True)):
        labels = _labelled(members, known)
        apart = side(labels, "i").crossJoin(side(labels, "j")).where(F.expr("i < j and least(low_i, low_j) < greatest(high_i, high_j)") & some).select("i", "j")
        found = components(known.select(F.col("cluster_id").alias("record_idx")).distinct(), _stars(blocks.join(labels.select("block", "ids", "labels"), "block"), apart))
        known = checkpointed(known.join(found.select(F.col("record_idx").alias("cluster_id"), F.col("cluster_id").alias("least")), "cluster_id").select("record_idx", F.col("least").alias("cluster_id")))
    return known.where("record_idx <> cluster_id").select(F.col("record_idx").alias("left"), F.col("cluster_id").alias("right"))


def matches(records: DataFrame, fuzzy: bool = True, complete: bool = False) -> DataFrame:
    """One row a pair, of the first rule that holds for it.

    Pairs that share a key or a name are those with its first record, and like names give one pair, which connects the same
    clusters; with ``complete`` all of them.
    With ``fuzzy`` pairs of records that both have a name come from their blocks, whichever rule holds for them.
    """
    keys = rule_keys(records)
    if not fuzzy:
        return first_rules(keys, key_pairs(keys, complete))
    blocks, members = _blocks(records, keys)
    has = lambda c: members.select(F.col("record_idx").alias(c), F.lit(True).alias(f"{c}_named"))
    pairs = key_pairs(keys, complete).join(has("left"), "left", "left").join(has("right"), "right", "left").where("left_named is null or right_named is null").select("left", "right")
    return first_rules(keys, pairs).union(_told(_named_matches(blocks, complete)))

"""Near duplicates by BagMinHash over word shingles.

A document is the multiset of its five-word shingles; similarity is weighted Jaccard, the sum of
the smaller counts over the sum of the larger ones.  Signatures follow BagMinHash: each shingle
carries Poisson processes over the discretised weights (one cell per whole count), arranged in
dyadic blocks [0,1), [1,2), [2,4), [4,8), ...  A block that lies below the count contributes all
of its points; the block that holds the count is split in halves again and again, a fair bit a
point, until each point's cell is known to lie below the count or not.  Every point falls on a
random register, and a register keeps its earliest point.  Two registers agree with probability
equal to the weighted Jaccard similarity.  Points come in order, so a process stops once it
passes the latest register: whole texts cost about one point a shingle.

Registers are banded; documents that agree on a band are candidates.  A bucket links its members
to the member that meets most others (never all pairs), and links are verified by exact multiset
overlap.  Members that fail are set against the rest of their bucket by their signatures, in
blocks held as arrays; what looks similar is verified there, as far as it connects what is not
connected yet.  Connected documents form a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm.common import cut, discard, if_small, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Two documents at the threshold share a band with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Signatures that agree on this share of registers or more are verified: the threshold less 4 standard errors.
SKETCH_FLOOR = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Members of a bucket that one task sets against as many others.
BLOCK = 1024

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, counts and document numbers from word hashes of texts in a row.

    A text of fewer words than ``size`` is one shingle; one without words has none.
    """
    ends = np.cumsum(lengths)
    made = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), made)
    at = np.arange(len(doc)) + np.repeat((ends - lengths) - (np.cumsum(made) - made), made)
    room = np.concatenate((words, np.zeros(size, dtype=np.uint64)))
    inside = ends[doc] - at
    h = np.zeros(len(doc), dtype=np.uint64)
    for k in range(size):
        part = mix(room[at + k] + _U(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        h += np.where(inside > k, part, _U(0)) if (lengths < size).any() else part
    h = mix(h)
    order = np.lexsort((h, doc)) if len(lengths) > 1 else np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    return h[starts], np.diff(starts, append=len(h)), doc[starts]


def bag_minhash(h: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Register minima (docs x registers) of multisets given as (hash, count, document)."""
    least = np.full((docs, registers), np.inf)
    # a process per (element, dyadic block of its weight); block 0 is [0, 1), block j is [2^(j-1), 2^j)
    blocks = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 2))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    rate = np.maximum(low, 1).astype(np.float64)
    seed = mix(h[of] ^ mix(block.astype(np.uint64) + _U(0x51)))
    limit, where = weights[of], doc[of]
    partial = low + rate.astype(np.int64) > limit
    t, step = np.zeros(len(of)), 0
    flat = least.reshape(-1)
    while len(t):
        step += 1
        a = mix(seed + _U(0x9E3779B97F4A7C15 * step % 2**64))
        b = mix(a ^ _U(0xD6E8FEB86659FD93))
        t = t - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = ((b >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        if partial.any():  # the low bits of b halve the block down to a unit cell
            cell = low + (b & (rate.astype(np.uint64) - _U(1))).astype(np.int64)
            ok = cell < limit
            np.minimum.at(flat, where[ok] * registers + register[ok], t[ok])
        else:
            np.minimum.at(flat, where * registers + register, t)
        go = t < least.max(axis=1)[where]
        t, seed, rate, low, limit, where, partial = (x[go] for x in (t, seed, rate, low, limit, where, partial))
    return least


def _hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _groups(batch: pa.RecordBatch, column: int, most_words: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their word hashes, so that no run is much above ``most_words``."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values).view(np.uint64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_words, side="right")) - 1)
        last = min(last, batch.num_rows, first + 1024)
        yield first, last, values[offsets[first] : offsets[last]], np.diff(offsets[first : last + 1])
        first = last


def _nodes_of(h: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int) -> list[bytes | None]:
    """128 bits that name each multiset; None for the empty one."""
    keys = np.zeros((docs, 2), dtype=np.uint64)
    c = counts.astype(np.uint64)
    for k, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
        np.add.at(keys[:, k], doc, mix(mix(h + _U(salt)) + c * _U(0x9E3779B97F4A7C15)))
    has = np.bincount(doc, minlength=docs) > 0
    return [keys[i].tobytes() if has[i] else None for i in range(docs)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, sketch, bands): no shuffle; texts without words have a null node.

    ``node`` names the multiset, ``sketch`` holds 16 bits a register, ``th`` a hash of the text.
    """
    ready = docs.select("doc_id", F.xxhash64("text").alias("th"), _hashed_words(F.col("text")).alias("w"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, lengths in _groups(batch, 2):
                n = last - first
                h, counts, doc = shingles(words, lengths)
                least = bag_minhash(h, counts, doc, n)
                bits = mix(least.view(np.uint64))
                bands = mix(bits.reshape(n, BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
                bands = mix(np.bitwise_xor.reduce(bands, axis=2)).view(np.int64)
                sketch = (bits & _U(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(_nodes_of(h, counts, doc, n), pa.binary()),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                        pa.array(list(bands), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "th", "node", "sketch", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(sign, f"doc_id {kind}, th long, node binary, sketch binary, bands array<long>")


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, bag) of the wanted (doc_id, th): the distinct shingles and their counts, packed."""
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    some = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, lengths in _groups(batch, 0):
                n = last - first
                h, counts, doc = shingles(words, lengths)
                ends = np.searchsorted(doc, np.arange(n), side="right")
                starts = np.searchsorted(doc, np.arange(n), side="left")
                bags = [h[a:b].tobytes() + counts[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_nodes_of(h, counts, doc, n), pa.binary()), pa.array(bags, pa.binary())], names=["node", "bag"])

    packed = some.select(_hashed_words(F.col("text")).alias("w")).mapInArrow(pack, "node binary, bag binary")
    return packed.where("node is not null").dropDuplicates(["node"])


def _overlap(x: bytes, y: bytes) -> float:
    """Weighted Jaccard of two packed bags."""
    a, b = (np.frombuffer(v, dtype=np.uint64, count=len(v) // 12) for v in (x, y))
    ca, cb = (np.frombuffer(v, dtype="<u4", offset=len(v) // 12 * 8).astype(np.int64) for v in (x, y))
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a
    shared = int(np.minimum(ca[same], cb[at[same]]).sum())
    return shared / (int(ca.sum()) + int(cb.sum()) - shared)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, by exact multiset overlap."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("doc_id", "th")
    bags = cut(_bags(docs, wanted), "bags")
    both = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            got = [_overlap(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(got, pa.float64())], names=["a", "b", "similarity"])

    out = cut(both.select("a", "b", "x", "y").mapInArrow(measure, "a binary, b binary, similarity double"), "verified")
    discard(bags)
    return out


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of (band, key, i, j, asks, ...) from members of buckets: blocks of a bucket set against blocks.

    Members that fail in their band ask, in their own block i against every block j; all members
    answer, in their own block j to every block i.  A task holds two blocks, whatever the bucket's size.
    """
    sizes = members.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = members.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = own.where("(shiftright(fails, band) & 1) = 1").select("band", "key", F.col("own").alias("i"), other.alias("j"), F.lit(True).alias("asks"), "node", "sketch", "fails")
    return asks.union(own.select("band", "key", other.alias("i"), F.col("own").alias("j"), F.lit(False), "node", "sketch", "fails"))


def _likely(table) -> tuple[list[bytes], list[tuple[float, int, int]]]:
    """The nodes of a task, and its likely pairs as (estimate, asking row, answering row), best first.

    A pair belongs to the first band that both share and in which one of them fails, so no pair
    is looked at twice.
    """
    node = table.column("node").to_pylist()
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    band = table.column("band")[0].as_py()
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u2").reshape(len(node), REGISTERS)
    fails = table.column("fails").to_numpy()
    rest, found = np.flatnonzero(~asks), []
    powers = 1 << np.arange(BANDS)
    for p in np.flatnonzero(asks):
        same = bits[rest] == bits[p]
        share = same.mean(axis=1)
        close = np.flatnonzero(share >= SKETCH_FLOOR)
        if len(close):
            agreed = same[close].reshape(len(close), BANDS, ROWS).all(axis=2)
            usable = agreed & (((fails[rest[close]] | fails[p])[:, None] & powers) > 0)
            close = close[usable.argmax(axis=1) == band]
        found += [(float(share[q]), int(p), int(rest[q])) for q in close if node[p] != node[rest[q]]]
    found.sort(reverse=True)
    return node, found


def _more_links(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of links in buckets of (band, key, node, sketch, fails), as few as connect the same members.

    A first pass finds by signatures alone which members have a likely partner in a task; only
    their bags travel there, and pairs already connected in the task are passed over.
    """
    task = ["band", "key", "i", "j"]

    def involve(key, table):
        node, found = _likely(table)
        rows = sorted({r for _, p, q in found for r in (p, q)})
        return table.take(pa.array(rows, pa.int64())).select([*task, "asks", "node", "sketch", "fails"])

    kinds = "band int, key long, i int, j int, asks boolean, node binary, sketch binary, fails int"
    involved = cut(_dealt(members).select(*task, "asks", "node", "sketch", "fails").groupBy(*task).applyInArrow(involve, kinds), "involved")
    wanted = nodes.join(involved.select("node").distinct(), "node", "left_semi").select("doc_id", "th")
    bags = _bags(docs, wanted)

    def connect(key, table):
        node, found = _likely(table)
        bag = table.column("bag")
        root = {x: x for x in node}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for _, p, q in found:
            x, y = top(node[p]), top(node[q])
            if x != y and _overlap(bag[p].as_py(), bag[q].as_py()) >= THRESHOLD:
                root[y] = x
                out.append((node[p], node[q]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})

    return cut(involved.join(bags, "node").select(*task, "asks", "node", "sketch", "fails", "bag").groupBy(*task).applyInArrow(connect, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node is connected with.

    Each round takes the least label among a node, its neighbours and its label's own label;
    rounds are written out, and their number grows with the logarithm of a chain's length.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        jumped = labels.alias("x").join(labels.alias("y"), F.col("x.root") == F.col("y.node")).select("x.node", F.col("y.root").alias("root"))
        told = labels.join(jumped.withColumnRenamed("root", "up"), "node").select(F.col("root").alias("node"), F.col("up").alias("root"))
        fresh = labels.union(heard).union(jumped).union(told).groupBy("node").agg(F.min("root").alias("root"))
        fresh = cut(fresh, "labels")
        moved = fresh.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        discard(labels)
        labels = fresh
        if not moved:
            return labels


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, th, class_id, copy_of, n_copies): the near-duplicate class of each row of (doc_id, text).

    ``copy_of`` is the least doc_id with the same multiset, ``class_id`` the least of the class.
    A document without words has no duplicates and is its own class, even where such texts are
    equal.  Ties need no rule: equal multisets share all.  Rows with a null doc_id take part; a
    class of nothing else has a null class_id.  Repeated rows each give a row.
    """
    sigs = cut(signatures(docs), "signatures")
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = cut(nodes.select("node", F.col("d.doc_id").alias("doc_id"), F.col("d.th").alias("th"), "copy_of", "n_copies", "sketch", "bands"), "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(members.join(sizes, ["band", "key"]), "members")
    degree = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = cut(shared.drop("size").join(degree, "node"), "ranked")
    heads = ranked.groupBy("band", "key").agg(F.max(F.struct("meets", "node"))["node"].alias("head"))
    stars = cut(ranked.join(heads, ["band", "key"]).where("node <> head").select("band", "key", "node", "head"), "stars")
    pairs = stars.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    first = _verified(docs, nodes, pairs)
    judged = stars.withColumns({"a": F.least("node", "head"), "b": F.greatest("node", "head")}).join(first, ["a", "b"])
    failing = judged.where(F.col("similarity") < THRESHOLD).select("band", "key", "node")
    hot = failing.select("band", "key").distinct()
    masks = failing.groupBy("node").agg(F.sum(F.expr("shiftleft(1, band)")).cast("int").alias("fails"))
    around = stars.join(hot, ["band", "key"], "left_semi").select("band", "key", "node").join(masks, "node", "left")
    around = around.join(nodes.select("node", "sketch"), "node").select("band", "key", "node", "sketch", F.coalesce("fails", F.lit(0)).alias("fails"))
    second = _more_links(docs, nodes, cut(around, "around"))
    roots = components(first.where(F.col("similarity") >= THRESHOLD).select("a", "b").union(second))
    named = nodes.select("node", "copy_of", "n_copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = named.join(least, "root").select("node", "copy_of", "n_copies", "class_id")
    out = sigs.select("doc_id", "th", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents of (doc_id, text, ...) with one document of each near-duplicate class: its least doc_id.

    Rows equal in doc_id and text are one document and stay or go together.  Where a class has an
    id, documents without one go; in a class of null ids alone all stay.
    """
    gone = find(docs).where(F.col("doc_id").isNull() & F.col("class_id").isNotNull() | (F.col("doc_id") != F.col("class_id")))
    gone = if_small(cut(gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "duplicates"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_anti")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every whole text of ``documents``, and how many documents have its very multiset.

    Null, empty and wordless texts are classes of their own; texts under five words are one shingle;
    repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).select("doc_id", "class_id", "copy_of", "n_copies")


QUERIES = {"op1_bagminhash": op1_bagminhash}
ORACLE_SQL: dict[str, str] = {}

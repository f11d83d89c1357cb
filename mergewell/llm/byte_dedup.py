"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``WINDOW`` bytes over it also starts earlier: in a document of a
smaller id, or earlier in its own.  Windows that could repeat are found first, so that suffix
arrays are built over repeated passages, not over the corpus:

1. Equal texts: of each, all rows but the first document's go whole.
2. Every window has an anchor, the 24-byte gram in it with the least hash (the leftmost of
   equals); equal windows have equal anchors at the same place.  Windows around an anchor that
   occurs once in the corpus cannot repeat.  Anchors are counted by a hash aggregate.
3. Runs of windows around a repeated anchor travel, with the bytes they cover, to the shard of
   the anchor's hash.  An anchor with very many runs is dealt over several shards.
4. A shard sorts its windows' suffixes: ranks by eight bytes, then Larsson-Sadakane refinement
   of the groups not yet told apart, doubling from 8 to 128 bytes.  Common prefixes of
   neighbours, taken for all neighbours at once, cut the array where they fall below a window.
   In each interval all but the earliest window are repeats.
5. Shards of one anchor are merged: each cuts the sorted fingerprints of its first windows at
   even bounds, and slices with the same bounds are searched in one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm.common import cut, discard, if_small

WINDOW, GRAM = 100, 24
#: Bytes hashed at a time; a longer text is hashed in pieces that overlap by a window.
CHUNK = 1 << 18
#: Runs of one anchor that a shard takes, and bytes that a shard is meant to hold.
RUNS_PER_SHARD, SHARD_BYTES = 20_000, 4 << 20
#: First windows that a merging task is meant to hold.
MERGE_WINDOWS = 1_000_000

_U = np.uint64
_NULL = np.iinfo(np.int64).min


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places on, as little-endian numbers; zeros follow the end."""
    room = np.zeros(-(-(n + 16) // 8) * 8, dtype=np.uint8)
    room[: min(len(data), len(room))] = data[: len(room)]
    out = np.empty(-(-n // 8) * 8, dtype="<u8")
    for r in range(8):
        out[r::8] = np.frombuffer(room.tobytes()[r : r + len(out)], dtype="<u8")
    return out[:n]


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in pieces that stand one after the other.

    Returns the first window's place in ``data``, the number of windows, the anchor's hash and the
    piece, of each run.  Pieces must be a window long or longer.
    """
    n = len(data)
    grams = n - GRAM + 1
    v = _words(data, n)
    h = v[:grams] * _U(0x9E3779B97F4A7C15)
    h += v[8 : grams + 8] * _U(0xC2B2AE3D27D4EB4F)
    h += v[16 : grams + 16] * _U(0x165667B19E3779F9)
    h = _mix(h)
    low = _U((1 << 20) - 1)
    least = (h & ~low) | np.arange(grams, dtype=np.uint64)
    size, width = 1, WINDOW - GRAM + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & low).astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    counts = lengths - WINDOW + 1
    piece = np.repeat(np.arange(len(ends)), counts)
    starts = np.arange(len(piece)) + np.repeat((ends - lengths) - (np.cumsum(counts) - counts), counts)
    at = anchor[starts]
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1]
    heads = np.flatnonzero(first)
    return starts[heads], np.diff(heads, append=len(at)), h[at[heads]].view(np.int64), piece[heads]


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts of a window or more, CHUNK at a time: data, piece ends, rows, offsets in the rows."""
    held, rows, offsets, size = [], [], [], 0
    for row, x in enumerate(texts):
        body = x.as_buffer() if x.is_valid else None
        if body is None or body.size < WINDOW:
            continue
        raw = np.frombuffer(body, dtype=np.uint8)
        for at in range(0, len(raw) - WINDOW + 1, CHUNK):
            part = raw[at : at + CHUNK + WINDOW - 1]
            if size and size + len(part) > 2 * CHUNK:
                yield np.concatenate(held), np.cumsum([len(p) for p in held]), np.array(rows), np.array(offsets)
                held, rows, offsets, size = [], [], [], 0
            held.append(part)
            rows.append(row)
            offsets.append(at)
            size += len(part)
    if held:
        yield np.concatenate(held), np.cumsum([len(p) for p in held]), np.array(rows), np.array(offsets)


def suffix_array(data: np.ndarray, places: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """``places`` sorted by the ``depth`` bytes behind them (at least), by Larsson-Sadakane refinement.

    All places of ``data`` are ranked by eight bytes; each round pairs the rank of a place with
    the rank of the place as far behind as is sorted already, in groups not yet told apart.
    A group's rank is its first index in the array.
    """
    n = len(data)
    key = _words(data, n).byteswap()
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1

    def settle(at: np.ndarray, base: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Give the sorted places ``at`` at indices ``base`` their groups' ranks; True where a group has company."""
        heads = np.flatnonzero(new)
        sizes = np.diff(heads, append=len(at))
        rank[at] = np.repeat(base[heads], sizes)
        return np.repeat(sizes > 1, sizes)

    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    index = np.arange(n)
    open_ = settle(order, index, new)
    h = 8
    while h < depth and open_.any():
        index = index[open_]
        at = order[index]
        after = rank[np.minimum(at + h, n)]
        own = rank[at]
        by = np.lexsort((after, own))
        at, own, after = at[by], own[by], after[by]
        order[index] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        open_ = settle(at, index, new)
        h *= 2
    wanted = np.zeros(n, dtype=bool)
    wanted[places] = True
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int = WINDOW) -> np.ndarray:
    """Bytes that each place of the array shares with the one before it, up to ``limit``; 0 for the first."""
    out = np.zeros(len(sa), dtype=np.int64)
    words = _words(data, len(data))
    live = np.arange(1, len(sa))
    for at in range(0, limit, 8):
        if not len(live):
            break
        a, b = np.minimum(sa[live] + at, len(data) - 1), np.minimum(sa[live - 1] + at, len(data) - 1)
        x = words[a] ^ words[b]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64) // 8)
        out[live] += same
        live = live[x == 0]
    return np.minimum(out, limit)


_DOC = "doc_id long, t long"
_MARKS = f"kind int, {_DOC}, lo int, hi int, hash long, part int, fp binary, pos binary"


def _table(kind, doc, t, lo, hi, hashes=None, parts=None, fps=None, pos=None) -> pa.Table:
    n = len(doc)
    nothing = [None] * n
    return pa.table(
        {
            "kind": pa.array(np.full(n, kind, dtype=np.int32)),
            "doc_id": pa.array(doc, pa.int64(), mask=doc == _NULL),
            "t": pa.array(t, pa.int64()),
            "lo": pa.array(lo, pa.int32()),
            "hi": pa.array(hi, pa.int32()),
            "hash": pa.array(nothing if hashes is None else hashes, pa.int64()),
            "part": pa.array(nothing if parts is None else parts, pa.int32()),
            "fp": pa.array(nothing if fps is None else fps, pa.binary()),
            "pos": pa.array(nothing if pos is None else pos, pa.binary()),
        }
    )


def _ranges(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of consecutive places within a row, from sorted (row, at): row, first, last."""
    if not len(row):
        return row, at, at
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    return row[heads], at[heads], at[np.append(heads[1:], len(row)) - 1]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, _NULL).to_numpy()


def sort_shard(table):
    """Mark the repeats among a shard's runs (doc_id, t, start, hash, spread, segment)."""
    doc, t, start = _ids(table.column("doc_id")), table.column("t").to_numpy(), table.column("start").to_numpy().astype(np.int64)
    order = np.lexsort((start, t, doc))
    doc, t, start = doc[order], t[order], start[order]
    hashes, spread = table.column("hash").to_numpy()[order], table.column("spread").to_numpy()[order]
    column = table.column("segment").combine_chunks()
    segments = [column[int(k)].as_py() for k in order]
    # equal runs: all but the first are repeats as a whole
    first: dict[bytes, int] = {}
    later = np.array([first.setdefault(s, k) != k for k, s in enumerate(segments)], dtype=bool)
    whole = np.flatnonzero(later)
    last = np.array([len(s) - WINDOW for s in segments], dtype=np.int64)
    out = [_table(0, doc[whole], t[whole], start[whole], start[whole] + last[whole])]
    # runs whose anchor has others
    kept = np.flatnonzero(~later)
    _, inverse, counts = np.unique(hashes[kept], return_inverse=True, return_counts=True)
    kept = kept[(counts[inverse] > 1) | (spread[kept] > 1)]
    if len(kept):
        data = np.frombuffer(b"".join([segments[k] for k in kept]), dtype=np.uint8)
        windows = last[kept] + 1
        begins = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
        row = np.repeat(kept, windows)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        places = np.repeat(begins, windows) + offset
        sa = suffix_array(data, places)
        interval = np.cumsum(common_prefixes(data, sa) < WINDOW)
        head = np.full(interval[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(head, interval, sa)
        # places ascend with the documents' order, so the least place is the earliest window
        number = np.empty(len(data), dtype=np.int64)
        number[places] = np.arange(len(places))
        repeats = np.sort(number[sa[sa != head[interval]]])
        r, lo, hi = _ranges(row[repeats], offset[repeats])
        out.append(_table(0, doc[r], t[r], start[r] + lo, start[r] + hi))
        firsts = number[head[1:][np.isin(hashes[row[number[head[1:]]]], hashes[kept][spread[kept] > 1])]] if (spread[kept] > 1).any() else []
        if len(firsts):
            out.append(_first_windows(data, places, firsts, row, offset, doc, t, start, hashes, spread))
    return pa.concat_tables(out)


def _first_windows(data, places, firsts, row, offset, doc, t, start, hashes, spread) -> pa.Table:
    """Sorted fingerprints of a spread anchor's first windows, cut at even bounds by binary search."""
    raw = data.tobytes()
    rows: dict[str, list] = {k: [] for k in ("doc", "t", "hash", "part", "fp", "pos")}
    for anchor in np.unique(hashes[row[firsts]]):
        mine = firsts[hashes[row[firsts]] == anchor]
        fps = np.array([xxhash.xxh3_128_digest(raw[p : p + WINDOW]) for p in places[mine]], dtype="V16").view(">u8").reshape(-1, 2)
        by = np.lexsort((fps[:, 1], fps[:, 0]))
        fps, mine = fps[by], mine[by]
        parts = max(1, int(-(-int(spread[row[mine[0]]]) * (WINDOW - GRAM) * RUNS_PER_SHARD // MERGE_WINDOWS)))
        bounds = np.array([(2**64 * k) // parts for k in range(1, parts)], dtype=np.uint64)
        cuts = [0, *np.searchsorted(fps[:, 0].astype(np.uint64), bounds).tolist(), len(mine)]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                k = row[mine[a:b]]
                rows["hash"].append(int(anchor))
                rows["part"].append(part)
                rows["fp"].append(fps[a:b].tobytes())
                rows["pos"].append(np.stack((doc[k], t[k], start[k] + offset[mine[a:b]])).astype("<i8").tobytes())
    n = len(rows["hash"])
    zero = np.zeros(n, dtype=np.int64)
    return _table(1, zero, zero, zero, zero, rows["hash"], rows["part"], rows["fp"], rows["pos"])


def merge_shards(table):
    """Mark first windows of a shard that stand earlier in another shard of the same anchor."""
    fp = np.concatenate([np.frombuffer(x, dtype=">u8").reshape(-1, 2) for x in table.column("fp").to_pylist()])
    doc, t, start = np.concatenate([np.frombuffer(x, dtype="<i8").reshape(3, -1) for x in table.column("pos").to_pylist()], axis=1)
    order = np.lexsort((start, t, doc))
    fp, doc, t, start = fp[order], doc[order], t[order], start[order]
    # the earliest of each fingerprint, then every window searched among them
    both = np.array([x.tobytes() for x in fp], dtype="V16").view("S16") if len(fp) else np.zeros(0, dtype="S16")
    known, at = np.unique(both, return_index=True)
    repeats = np.flatnonzero(at[np.searchsorted(known, both)] != np.arange(len(both)))
    key = np.lexsort((start[repeats], t[repeats], doc[repeats]))
    d, u, s = doc[repeats][key], t[repeats][key], start[repeats][key]
    return pa.table({"doc_id": pa.array(d, pa.int64(), mask=d == _NULL), "t": pa.array(u, pa.int64()), "lo": pa.array(s, pa.int32()), "hi": pa.array(s, pa.int32())})


def _same(a: str = "doc_id", b: str = "_d"):
    return F.col(a).eqNullSafe(F.col(b)) & (F.col("t") == F.col("_t"))


def _later_copies(docs: DataFrame) -> DataFrame:
    """(_d, _t) of documents whose text a smaller doc_id has too."""
    named = docs.select("doc_id", "t", F.xxhash64(F.lit("2"), "text").alias("u"))
    # a null id comes first
    place = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")
    firsts = named.groupBy("t", "u").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = named.join(firsts, ["t", "u"]).where(place != F.col("first"))
    return cut(later.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct(), "copies")


def _anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, t, start, hash): each run of windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, rows, offsets in _pieces(batch.column(2)):
                start, _, hashes, piece = runs_of(data, ends)
                row = rows[piece]
                begin = ends - np.diff(ends, prepend=0)
                at = (start - begin[piece] + offsets[piece]).astype(np.int32)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at), pa.array(hashes)], names=["doc_id", "t", "start", "hash"])

    return docs.select("doc_id", "t", "text").mapInArrow(read, f"{_DOC}, start int, hash long")


def _segments(docs: DataFrame) -> DataFrame:
    """(doc_id, t, start, hash, spread, segment) of the runs named in ``starts`` and ``spreads`` of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [(np.asarray(s.values), np.asarray(c.values)) for s, c in zip(batch.column(3), batch.column(4), strict=True)]
            for data, ends, rows, offsets in _pieces(batch.column(2)):
                start, windows, hashes, piece = runs_of(data, ends)
                row = rows[piece]
                begin = ends - np.diff(ends, prepend=0)
                at = start - begin[piece] + offsets[piece]
                raw = data.tobytes()
                out: list[tuple] = []
                bounds = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(bounds, [*bounds[1:], len(row)], strict=True):
                    names, spreads = wanted[row[a]]
                    by = np.argsort(names)
                    k = np.minimum(np.searchsorted(names[by], at[a:b]), len(names) - 1)
                    hit = np.flatnonzero(names[by][k] == at[a:b])
                    out += [(row[a], at[a + i], hashes[a + i], spreads[by][k[i]], raw[start[a + i] : start[a + i] + windows[a + i] + WINDOW - 1]) for i in hit]
                if out:
                    r, s, h, c, seg = zip(*out, strict=True)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(s, pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.int32()), pa.array(seg, pa.binary())],
                        names=["doc_id", "t", "start", "hash", "spread", "segment"],
                    )

    return docs.select("doc_id", "t", "text", "starts", "spreads").mapInArrow(read, f"{_DOC}, start int, hash long, spread int, segment binary")


def repeats(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, t, lo, hi): stretches of windows, by first bytes, that start earlier; for first rows of each text."""
    firsts = docs.join(if_small(copies), _same(), "left_anti")
    anchors = _anchors(firsts)
    counts = anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = cut(counts.select("hash", F.ceil(F.col("n") / F.lit(RUNS_PER_SHARD)).cast("int").alias("spread")), "anchors")
    named = anchors.join(counts, "hash").groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "spread")).alias("s"))
    named = cut(named.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), F.col("s.start").alias("starts"), F.col("s.spread").alias("spreads")), "runs")
    runs = named.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("n")).first()["n"]
    discard(counts)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(runs) * 140 // SHARD_BYTES))
    segments = _segments(firsts.join(named, _same()))
    salt = F.when(F.col("spread") > 1, F.pmod(F.xxhash64("doc_id", "t"), F.col("spread"))).otherwise(F.lit(0))
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("hash", salt), F.lit(shards)).cast("int"))
    marks = cut(dealt.groupBy("shard").applyInArrow(sort_shard, _MARKS), "marks")
    discard(named)
    merged = marks.where("kind = 1").groupBy("hash", "part").applyInArrow(merge_shards, f"{_DOC}, lo int, hi int")
    return marks.where("kind = 0").select("doc_id", "t", "lo", "hi").union(merged)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of (doc_id, text), whole texts.

    A null text has no bytes; texts under a window's length lose nothing.  A null doc_id comes
    before all others.  Rows equal in doc_id and text are one document, and documents of equal
    ids are ordered by a hash of the text.  Ids must be whole numbers.  ``kept`` is the
    rest of the bytes.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number: spans keep ids as longs")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("t", F.xxhash64("text"))
    copies = _later_copies(docs)
    ranges = repeats(docs, copies).groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    ranges = ranges.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), F.col("r.lo").alias("los"), F.col("r.hi").alias("his"), F.lit(False).alias("copy"))
    none = F.array().cast("array<int>")
    verdicts = cut(ranges.union(copies.select("_d", "_t", none, none, F.lit(True))), "ranges")
    rows = docs.join(verdicts, _same(), "left").select("doc_id", "text", "los", "his", "copy")

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, digests, rests = [], [], [], [], []
            for text, los, his, copy in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if copy.is_valid and copy.as_py() and len(raw) >= WINDOW:
                    rest, n = b"", 1
                elif los.is_valid and len(los):
                    lo, hi = np.asarray(los.values), np.asarray(his.values)
                    by = np.argsort(lo)
                    lo, hi = lo[by], np.maximum.accumulate(hi[by] + WINDOW)
                    heads = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    begins, stops = lo[heads], hi[np.append(heads[1:], len(lo)) - 1]
                    rest = b"".join([raw[a:b] for a, b in zip([0, *stops.tolist()], [*begins.tolist(), len(raw)], strict=True)])
                    n = len(begins)
                else:
                    rest, n = raw, 0
                sizes.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                rests.append(rest)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            values = [pa.array(v, k) for v, k in zip((sizes, gone, spans, digests, rests), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(strike, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text of ``documents`` without its repeated 100-byte strings, as counts and a digest.

    Null and empty texts have no bytes and the digest of nothing; repeated rows are one document and
    each give a row; an empty table gives none; other cases as in :func:`find`.
    """
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op10_suffix_arrays": op10_suffix_arrays}
ORACLE_SQL: dict[str, str] = {}

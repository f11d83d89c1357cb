"""Token ids as wavelet matrices: one compressed blob per run of documents.

A wavelet matrix stores a sequence of ids as one bit plane per bit, highest first; each plane
sorts the sequence stably by its bit before the next one is taken.  With a count of ones
before each block of bits, any id is read, counted or found without unpacking the rest.

Blob, little-endian: magic ``WVM2``, u32 levels, u64 tokens, u64 documents, then a zstd frame of
u32 tokens per document, and per level u64 zeros, a zstd frame of the u32 counts of ones before each
block, and per ``PIECE`` bytes of the packed plane a zstd frame; every frame follows a u64 of its
length.  Opening a blob unpacks nothing: a look-up unpacks one piece a level, whatever the blob's size.
:func:`occurrences` and :func:`tokens_at` look through all blobs of a table that way.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergewell.llm.common import scratch_path

MAGIC = b"WVM2"
#: Bits of a plane between two stored counts.
BLOCK = 512
#: Bytes of a plane that are compressed together.
PIECE = 8192
#: A blob is closed at the document that takes it to this many ids or more.
BLOB_TOKENS = 1 << 18
#: Documents are encoded so many bytes at a time, about; a longer one alone.
SLICE_BYTES = 8 << 20
#: Bytes of text per range of documents, about.
RANGE_BYTES = 16 << 20
END_ID = 1


class _Plane:
    """One bit plane: packed bits in compressed pieces, each unpacked when it is first needed."""

    def __init__(self, n: int, pieces: list, before: np.ndarray | None = None):
        self.n, self.pieces, self._before = n, pieces, before

    @classmethod
    def of(cls, ones: np.ndarray) -> _Plane:
        packed = np.packbits(ones)
        return cls(len(ones), [packed[k : k + PIECE] for k in range(0, len(packed), PIECE)])

    def piece(self, k: int) -> np.ndarray:
        found = self.pieces[k]
        if not isinstance(found, np.ndarray):
            size = min(PIECE, -(-self.n // 8) - k * PIECE)
            found = self.pieces[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(found, max_output_size=size), dtype=np.uint8)
        return found

    def packed(self) -> np.ndarray:
        return np.concatenate([self.piece(k) for k in range(len(self.pieces))]) if self.pieces else np.zeros(0, dtype=np.uint8)

    def before(self) -> np.ndarray:
        """Ones before each block."""
        if self._before is None:
            packed, step = self.packed(), BLOCK // 8
            room = np.zeros(-(-len(packed) // step) * step, dtype=np.uint8)
            room[: len(packed)] = packed
            per = np.bitwise_count(room).reshape(-1, step).sum(axis=1, dtype=np.int64)
            self._before = np.concatenate(([0], np.cumsum(per))).astype("<u4")
        elif not isinstance(self._before, np.ndarray):
            size = 4 * (-(-(-(-self.n // 8)) // (BLOCK // 8)) + 1)
            self._before = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._before, max_output_size=size), dtype="<u4")
        return self._before

    def bit(self, i: int) -> int:
        return int(self.piece(i // 8 // PIECE)[i // 8 % PIECE]) >> (7 - i % 8) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        block = i // BLOCK
        ones = int(self.before()[block])
        if i % BLOCK:
            lo, hi = block * BLOCK // 8, i // 8
            piece, base = self.piece(lo // PIECE), lo // PIECE * PIECE  # a block lies in one piece
            ones += int(np.bitwise_count(piece[lo - base : hi - base]).sum())
            if i % 8:
                ones += (int(piece[hi - base]) >> (8 - i % 8)).bit_count()
        return ones


class WaveletMatrix:
    """Access, counting and lookup over a sequence of non-negative ids below 2**32."""

    def __init__(self, n: int, zeros: list[int], planes: list[_Plane], doc_lengths: np.ndarray):
        self.n, self.zeros, self.planes, self.doc_lengths = n, zeros, planes, doc_lengths
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, doc_lengths: np.ndarray | None = None, levels: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids)
        top = int(ids.max()) if len(ids) else 0
        levels = levels or max(1, top.bit_length())
        if top >> levels:
            raise ValueError(f"an id needs more than {levels} bits")
        cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes = [], []
        for shift in range(levels - 1, -1, -1):
            ones = (cur & cur.dtype.type(1 << shift)) != 0
            planes.append(_Plane.of(ones))
            low, high = np.compress(~ones, cur), np.compress(ones, cur)
            zeros.append(len(low))
            cur = np.concatenate((low, high))
        lengths = np.array([len(ids)] if doc_lengths is None else doc_lengths, dtype=np.uint32)
        return cls(len(ids), zeros, planes, lengths)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.bit(i), plane.rank1(i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, value: int, end: int) -> tuple[int, int]:
        """Where copies of a value among the first ``end`` places stand below the last plane."""
        lo, hi = 0, end
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            if lo == hi:
                break
            a, b = plane.rank1(lo), plane.rank1(hi)
            if value >> (self.levels - 1 - level) & 1:
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, end: int | None = None) -> int:
        """How often a value occurs among the first ``end`` places (all, if None)."""
        if value < 0 or value >> self.levels:
            return 0
        lo, hi = self._span(value, self.n if end is None else min(end, self.n))
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of a value, k from 0."""
        if not 0 <= k < self.rank(value):
            raise IndexError(k)
        at = self._span(value, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th bit of a kind, by bisecting the counts before blocks, then inside one."""
        plane = self.planes[level]
        before = plane.before().astype(np.int64)
        counts = before if bit else np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(counts, k, side="right")) - 1
        lo, hi = block * BLOCK, min((block + 1) * BLOCK, self.n)
        while lo < hi:
            mid = (lo + hi) // 2
            ones = plane.rank1(mid + 1)
            if (ones if bit else mid + 1 - ones) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def places(self, value: int) -> list[int]:
        """All places of a value, ascending."""
        return [self.select(value, k) for k in range(self.rank(value))]

    def decode(self) -> np.ndarray:
        """All ids in order: the stable sorts undone from the last plane upwards."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        value = np.zeros(self.n, dtype=kind)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level].packed(), count=self.n).view(bool)
            before = np.empty_like(value)
            before[np.flatnonzero(~ones)] = value[: self.zeros[level]]
            before[np.flatnonzero(ones)] = value[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            value = before
        return value

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [MAGIC, struct.pack("<IQQ", self.levels, self.n, len(self.doc_lengths))]

        def put(body: np.ndarray) -> None:
            frame = pack(body.tobytes())
            parts.extend((struct.pack("<Q", len(frame)), frame))

        put(self.doc_lengths.astype("<u4"))
        for zeros, plane in zip(self.zeros, self.planes, strict=True):
            parts.append(struct.pack("<Q", zeros))
            put(plane.before())
            for k in range(len(plane.pieces)):
                put(plane.piece(k))
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        view = memoryview(blob)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a wavelet blob")
        levels, n, docs = struct.unpack_from("<IQQ", view, 4)
        at = 24

        def frame() -> memoryview:
            nonlocal at
            (size,) = struct.unpack_from("<Q", view, at)
            at += 8 + size
            return view[at - size : at]

        lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame(), max_output_size=max(1, 4 * docs)), dtype="<u4")
        zeros, planes = [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", view, at)[0])
            at += 8
            before = frame()
            planes.append(_Plane(n, [frame() for _ in range(-(-(-(-n // 8)) // PIECE))], before))
        return cls(n, zeros, planes, lengths)


#: Plain Latin letters: the tokenizer's pattern cuts one stop behind them off, and its
#: lower-casing works on each letter alone.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


#: Byte-level vocabularies write bytes that do not print as letters from U+0100 on.
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b))}


class ChunkEncoder:
    """A lower-casing tokenizer behind a table of the chunks between spaces and line feeds.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its chunks in order.  Words that differ by case or by one stop share an entry's ids.  The
    table starts anew when it holds ``limit`` chunks.
    """

    def __init__(self, tokenizer_file: str, end_id: int, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.limit = Tokenizer.from_file(tokenizer_file), end_id, limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        # words of plain letters, written as bytes, need no normalizing and no splitting: the same merges alone
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        ends = spec["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(ends)]] = True
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.array([self.end_id], dtype=np.uint32)
        self.starts, self.sizes = np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.int32)

    def _learn(self, fresh: list[str]) -> None:
        """Number and encode the chunks met for the first time."""
        numbers, count = self.numbers, len(self.sizes)
        plain: list[tuple[str, int]] = []
        odd: list[tuple[str, int]] = []
        joined: list[tuple[int, int, int]] = []
        for chunk in fresh:
            body, stop = (chunk[:-1], chunk[-1]) if chunk[-1:] in (".", ",") else (chunk, "")
            ascii_ = body.isascii()
            if not (body.isalpha() if ascii_ else PLAIN.fullmatch(body)):
                if chunk not in numbers:
                    numbers[chunk] = count
                    odd.append((chunk, count))
                    count += 1
                continue
            lower = body.lower()
            number = numbers.get(lower)
            if number is None:
                number = numbers[lower] = count
                plain.append((lower if ascii_ else lower.encode().decode("latin-1").translate(BYTE_LETTERS), count))
                count += 1
            if stop:
                mark = numbers.get(stop)
                if mark is None:
                    mark = numbers[stop] = count
                    odd.append((stop, count))
                    count += 1
                joined.append((count, number, mark))
                number = count
                count += 1
            numbers[chunk] = number
        more = count - len(self.sizes)
        self.starts, self.sizes = (np.concatenate((x, np.zeros(more, dtype=np.int32))) for x in (self.starts, self.sizes))
        flat, size = [self.flat], len(self.flat)
        for first in range(0, len(odd), 4096):
            some = odd[first : first + 4096]
            for (_, number), e in zip(some, self.tokenizer.encode_batch([c for c, _ in some], add_special_tokens=False), strict=True):
                flat.append(np.array(e.ids, dtype=np.uint32))
                self.starts[number], self.sizes[number] = size, len(e.ids)
                size += len(e.ids)
        for first in range(0, len(plain), 8192):
            some = plain[first : first + 8192]
            lines = [" ".join([c for c, _ in some[k : k + 512]]) for k in range(0, len(some), 512)]
            got = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[got]) + 1
            at = [n for _, n in some]
            self.sizes[at] = np.diff(ends, prepend=0)
            self.starts[at] = size + np.concatenate(([0], ends[:-1]))
            flat.append(got)
            size += len(got)
        self.flat = np.concatenate(flat)
        if joined:
            number, body, mark = np.array(joined, dtype=np.int64).T
            sizes = np.stack((self.sizes[body], self.sizes[mark]), axis=1).reshape(-1)
            ends = np.cumsum(sizes)
            starts = np.stack((self.starts[body], self.starts[mark]), axis=1).reshape(-1)
            ids = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
            self.sizes[number] = sizes[::2] + sizes[1::2]
            self.starts[number] = (ends - sizes)[::2] + len(self.flat)
            self.flat = np.concatenate((self.flat, ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and how many each has."""
        if len(self.numbers) > self.limit:
            self._clear()
        chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = np.asarray(chunks.offsets, dtype=np.int64)[1:] - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.numbers.get, known, repeat(-1)), dtype=np.int32, count=len(known))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            new = known[fresh].tolist()
            self._learn(new)
            numbers[fresh] = np.fromiter(map(self.numbers.__getitem__, new), dtype=np.int32, count=len(new))
        at = np.insert(numbers.take(coded.indices), ends, 0)
        sizes = self.sizes.take(at)
        stops = np.cumsum(sizes, dtype=np.int32)
        place = np.repeat(self.starts.take(at) - (stops - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat.take(place), np.diff(stops[ends + np.arange(len(ends))], prepend=0)


_ENCODERS: dict = {}


def _encoder(tokenizer_file: str, end_id: int) -> ChunkEncoder:
    """One per Python worker."""
    if (tokenizer_file, end_id) not in _ENCODERS:
        _ENCODERS[tokenizer_file, end_id] = ChunkEncoder(tokenizer_file, end_id)
    return _ENCODERS[tokenizer_file, end_id]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``SLICE_BYTES``, one row at least."""
    ends = np.asarray(pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield first, last
        first = last


BLOB_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, blob binary"
DOC_SCHEMA = "part int, seq int, at int, doc_id long, offset long, n_tokens long, ids_crc32 long"


def write_blobs(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, range_bytes: int = RANGE_BYTES, blob_tokens: int = BLOB_TOKENS) -> None:
    """Encode (doc_id, text) and write wavelet blobs to ``path`` in ascending doc_id order; ids must be whole numbers.

    Documents are dealt by ranges of doc_id and sorted inside each range (null first; equal ids
    by text); a null text is empty and holds the end id alone.  A task writes blob after blob
    and holds one at a time, so a range of any size fits.  An empty table writes no blob.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number: blobs keep ids as longs")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    ranges = max(1, -(-size // range_bytes))
    ordered = docs.repartitionByRange(int(ranges), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer_file, end_id), TaskContext.get().partitionId(), 0
        held: list = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal held, tokens, seq
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            row = [part, seq, len(ids), [i for h in held for i in h[0]], WaveletMatrix.build(ids, lengths).to_bytes()]
            held, tokens, seq = [], 0, seq + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "n_tokens", "doc_ids", "blob"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for first, last in _slices(batch.column(1)):
                ids, lengths = encoder.encode(batch.column(1).slice(first, last - first))
                stops = np.cumsum(lengths)
                done = 0
                while done < last - first:  # a blob takes documents until it is full
                    before = int(stops[done - 1]) if done else 0
                    k = min(int(np.searchsorted(stops, before + blob_tokens - tokens)) + 1, last - first)
                    held.append((numbers[first + done : first + k], ids[before : stops[k - 1]], lengths[done:k]))
                    tokens += int(stops[k - 1]) - before
                    done = k
                    if tokens >= blob_tokens:
                        yield close()
        if held:
            yield close()

    ordered.mapInArrow(blobs, BLOB_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the blobs: place, ids before it in its blob, ids, checksum."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, _, doc_ids, blob = (batch.column(c)[row] for c in range(5))
                matrix = WaveletMatrix.from_bytes(blob.as_buffer())
                ids, lengths = matrix.decode().astype("<u4"), matrix.doc_lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * k, pa.int32()),
                        pa.array([seq.as_py()] * k, pa.int32()),
                        pa.array(np.arange(k, dtype=np.int32)),
                        doc_ids.values,
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "seq", "at", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    return spark.read.schema(BLOB_SCHEMA).parquet(path).mapInArrow(unpack, DOC_SCHEMA)


def with_starts(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before each: ranges first, then blobs in a range.

    Only a row per range meets in one task; blobs are summed inside their range.
    """
    blobs = spark.read.schema(BLOB_SCHEMA).parquet(path).select("part", "seq", F.col("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blobs.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seqs = blobs.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("seq_start"))
    places = seqs.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("blob_start"))
    return docs.join(places, ["part", "seq"]).withColumn("start", F.col("blob_start") + F.col("offset")).drop("blob_start")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, n, places): of each document that has a token, how often and at which of its own places.

    Blobs are searched by rank and select where they lie; none is decoded.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column(1)[row].as_buffer())
                places = np.array(matrix.places(token), dtype=np.int64)
                if not len(places):
                    continue
                ends = np.cumsum(matrix.doc_lengths.astype(np.int64))
                of = np.searchsorted(ends, places, side="right")
                docs, counts = np.unique(of, return_counts=True)
                own = places - (ends - matrix.doc_lengths)[of]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values.take(pa.array(docs)), pa.array(counts.astype(np.int64)), lists], names=["doc_id", "n", "places"])

    return spark.read.schema(BLOB_SCHEMA).parquet(path).select("doc_ids", "blob").mapInArrow(search, "doc_id long, n long, places array<long>")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, at, token) of rows (doc_id, at): the id at a document's own place, null behind its end.

    The places are sent to the blobs that hold their documents; each is read by itself.
    """
    blobs = spark.read.schema(BLOB_SCHEMA).parquet(path)
    where = blobs.select("part", "seq", F.posexplode("doc_ids").alias("row", "doc_id"))
    asked = wanted.select("doc_id", "at").distinct().join(where, "doc_id").groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "row", F.col("at").cast("long").alias("at"))).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix, asked = WaveletMatrix.from_bytes(batch.column(0)[row].as_buffer()), batch.column(1)[row].as_py()
                starts = np.cumsum(matrix.doc_lengths.astype(np.int64)) - matrix.doc_lengths
                got = [matrix.access(int(starts[x["row"]]) + x["at"]) if 0 <= x["at"] < matrix.doc_lengths[x["row"]] else None for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"] for x in asked], pa.int64()), pa.array([x["at"] for x in asked], pa.int64()), pa.array(got, pa.int64())], names=["doc_id", "at", "token"])

    return blobs.join(asked, ["part", "seq"]).select("blob", "asked").mapInArrow(read, "doc_id long, at long, token long")


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all ``documents`` written as wavelet blobs, and what the files say on being read back.

    Null and empty texts hold the end id alone; rows with equal ids are ordered by text; a null id
    comes first; an empty table gives no row; other columns are not read.
    """
    import public_tokenizers

    path = scratch_path(spark, "wavelet")
    write_blobs(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    docs = with_starts(spark, path, read_documents(spark, path))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "seq")


QUERIES = {"op2_wavelet_tokens": op2_wavelet_tokens}
ORACLE_SQL: dict[str, str] = {}

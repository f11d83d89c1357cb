"""Language identification by a byte convolutional network, trained and applied in numpy.

Lower-cased UTF-8 bytes fall into classes (a letter each, space, digit, other ASCII, each byte
from 0x80 on), classes have embeddings, filters of several widths slide over a fixed-length
window, each filter keeps its maximum, and a softmax over the rectified maxima gives the
window's languages.  A text is all of its windows: their log probabilities are averaged by the
bytes they hold.  For applying, embeddings and filters fold into tables indexed by pairs of
classes, so a convolution is a few table look-ups a byte, whatever the embedding's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "und"
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
#: Bytes in a window.
WINDOW = 256
#: The classifier is fitted on about this many labelled documents of each language, chosen by
#: a hash of doc_id, and on this many windows of each, spread over its text.
TRAIN_DOCS_PER_LANGUAGE, TRAIN_WINDOWS = 1500, 2
EPOCHS, BATCH, RATE = 6, 128, 0.004


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 space, 1 digit, 2 other ASCII, 3 to 28 letters, then bytes from 0x80 on."""
    classes = np.full(256, 2, dtype=np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = 0
    classes[0x30:0x3A] = 1
    classes[0x61:0x7B] = np.arange(3, 29)
    classes[0x80:] = np.arange(29, 29 + 128)
    return classes


CLASSES, N_CLASSES = byte_classes(), 29 + 128


class ByteConvNet:
    """Embedding, convolutions of several widths, maximum over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (N_CLASSES, EMBED)).astype(np.float32)
        self.kernels = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, self.bias, self.out, self.out_bias]

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteConvNet:
        """Adam on the cross-entropy; classes weigh the same however many windows they have."""
        rng = np.random.default_rng(seed)
        share = np.bincount(target, minlength=len(self.languages))
        weight = (len(target) / np.maximum(share, 1) / len(self.languages)).astype(np.float32)[target]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self._weights()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for first in range(0, len(order), BATCH):
                some, step = order[first : first + BATCH], step + 1
                for w, g, (m, v) in zip(self._weights(), self._gradients(windows[some], target[some], weight[some]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = np.arange(len(x))
        e = self.embed[x]
        tops, places = [], []
        for w, k in zip(WIDTHS, self.kernels, strict=True):
            span = x.shape[1] - w + 1
            conv = sum(e[:, i : i + span] @ k[i] for i in range(w))
            at = conv.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(conv, at[:, None], axis=1)[:, 0])
        raw = np.concatenate(tops, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[n, y] -= 1
        p *= (weight / len(x))[:, None]
        back = (p @ self.out.T) * (raw > 0)
        g_embed, g_kernels = np.zeros_like(self.embed), []
        for j, (w, k, at) in enumerate(zip(WIDTHS, self.kernels, places, strict=True)):
            g, g_k = back[:, j * FILTERS : (j + 1) * FILTERS], np.zeros_like(k)
            for i in range(w):
                seen = x[n[:, None], at + i]
                g_k[i] = np.einsum("bf,bfd->df", g, self.embed[seen])
                np.add.at(g_embed, seen, g[:, :, None] * k[i].T[None])
            g_kernels.append(g_k)
        return [g_embed, *g_kernels, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def folded(self) -> ByteConvNet:
        """Tables for applying: by pair of classes, and by class for an odd last place."""
        one = [[self.embed @ k[i] for i in range(w)] for w, k in zip(WIDTHS, self.kernels, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        self.tables = [[pair(t[i], t[i + 1]) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in one]
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for each window of classes."""
        pairs = x[:, :-1].astype(np.int32) * N_CLASSES + x[:, 1:]
        tops = []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            span = x.shape[1] - w + 1
            conv = None
            for i, table in zip(range(0, w, 2), tables, strict=True):
                got = np.take(table, (pairs if i + 1 < w else x)[:, i : i + span], axis=0)
                conv = got if conv is None else np.add(conv, got, out=conv)
            while span > 1:
                half = (span + 1) // 2
                conv = np.maximum(conv[:, :half], conv[:, span - half : span])
                span = half
            tops.append(conv[:, 0])
        z = np.maximum(np.concatenate(tops, axis=1) + self.bias, 0) @ self.out + self.out_bias
        z = z.astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts that stand one after the other, as class windows; each text starts a window of its own.

    Returns the windows and how many each text has (one at least).  The last is filled up with spaces.
    """
    counts = np.maximum(1, -(-lengths // window))
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) * window, dtype=np.uint8)
    shift = starts * window - (np.cumsum(lengths) - lengths)
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = CLASSES[data]
    return out.reshape(-1, window), counts


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = TRAIN_DOCS_PER_LANGUAGE, per_doc: int = TRAIN_WINDOWS) -> ByteConvNet | None:
    """Fit on (doc_id, text, lang) that are not held out and have a language, a text and an id; None if there are none."""
    usable = docs.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    part = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1_000_000))
    chosen = usable.where(F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, per_language / n) * 1_000_000)))]), F.col("lang")) > part)
    text = F.lower("text")
    at = [F.substring(text, (F.greatest(F.length("text") - WINDOW, F.lit(0)) * F.lit(k / max(1, per_doc - 1))).cast("int") + 1, F.lit(WINDOW)) for k in range(per_doc)]
    rows = chosen.select("lang", F.explode(F.array_distinct(F.array(*at))).alias("text")).toPandas().sort_values(["lang", "text"])
    bits = [t.encode()[:WINDOW] for t in rows["text"]]
    data, lengths = np.frombuffer(b"".join(bits), dtype=np.uint8), np.array([len(b) for b in bits], dtype=np.int64)
    x, _ = windows_of(data, lengths)
    return ByteConvNet(languages).fit(x, np.searchsorted(languages, rows["lang"].to_numpy(dtype=str)))


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of (doc_id, text), by its whole text; no shuffle.

    Texts that are null, empty or without a letter, and all where nothing could be learned, are
    ``und`` with score 0.  Repeated rows each give a row.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if net is not None else F.lit(False)
    ready = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.when(has_letter, F.lower("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net is not None:
            net.folded()
        for batch in batches:
            texts = batch.column(2)
            lengths = np.zeros(len(texts), dtype=np.int64) if not len(texts) else np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
            best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            first = 0
            while first < len(texts) and net is not None:
                last, size = first + 1, lengths[first]
                while last < len(texts) and size + lengths[last] <= 1 << 19:
                    size += lengths[last]
                    last += 1
                best[first:last], score[first:last] = _read_texts(net, texts.slice(first, last - first), lengths[first:last])
                first = last
            known = np.asarray(texts.is_valid()) & (lengths > 0)
            names = pa.array([net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)] if net is not None else [UNKNOWN] * len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return ready.mapInArrow(read, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _read_texts(net: ByteConvNet, texts: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its probability for each text."""
    data = np.frombuffer(b"".join(x.as_buffer() for x in texts if x.is_valid), dtype=np.uint8)
    x, counts = windows_of(data, lengths)
    by_window = np.concatenate([net.log_probabilities(x[k : k + 1024]) for k in range(0, len(x), 1024)])
    starts = np.cumsum(counts) - counts
    held = np.full(len(x), float(WINDOW))
    held[starts + counts - 1] = np.maximum(1, lengths - (counts - 1) * WINDOW)
    mean = np.add.reduceat(by_window * held[:, None], starts, axis=0) / np.add.reduceat(held, starts)[:, None]
    p = _softmax(mean)
    return p.argmax(axis=1), p.max(axis=1)


def op4_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, by a network fitted on those that are not held out.

    Null, empty and letterless texts are ``und`` with score 0, as all are where no language was
    learned; a null id teaches nothing but is judged; an empty table gives no row; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs))


QUERIES = {"op4_byte_convnet": op4_byte_convnet}
ORACLE_SQL: dict[str, str] = {}

"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from mergewell.llm import bpe, byte_dedup, decontam, langid, line_dedup, near_dup, pii, quality, sharding, wavelet
from mergewell.llm.common import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def bench(spark, rows=((0, "alpha beta gamma delta epsilon zeta eta theta"), (1, None), (2, ""), (None, "x y"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def wavelet_rows(spark, df):
    path = scratch_path(spark, "t")
    wavelet.write_blobs(df, path, WORD, blob_tokens=1000)
    return wavelet.with_starts(spark, path, wavelet.read_documents(spark, path))


RUNS = {
    "near": lambda s, d: near_dup.find(d),
    "keep_one": lambda s, d: near_dup.keep_one(d),
    "wavelet": wavelet_rows,
    "sharding": lambda s, d: sharding.assign(d, "doc_id", sharding.even_shards(3), sharding.even_shards(4), order=["doc_id", "text"]),
    "langid": lambda s, d: langid.predict(d, langid.train(d)),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "quality": lambda s, d: quality.judge(d, labels(s, [(1, 1), (1, 0), (None, 1), (5, None), (6, 0)])),
    "quality_keep": lambda s, d: quality.keep(d, labels(s, [(1, 1)])),
    "bpe": lambda s, d: bpe.digests(d, BYTE),
    "leaks": lambda s, d: decontam.find(d, bench(s)),
    "remove_leaks": lambda s, d: decontam.remove_leaks(d, bench(s)),
    "pii": lambda s, d: pii.find(d),
    "redact": lambda s, d: pii.redact(d),
    "bytes": lambda s, d: byte_dedup.find(d),
}
ROWS = {"leaks": 3, "remove_leaks": 6}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, odd, name):
    got = RUNS[name](spark, odd).toPandas()
    if name == "quality_keep":
        assert set(got["doc_id"].dropna().astype(int)) == {1, 7} and len(got) == 4
    elif name == "keep_one":
        assert len(got) == 8  # copies of document 1 go; its repeated rows, wordless and lone texts stay
    else:
        assert len(got) == ROWS.get(name, 10)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, nothing, name):
    assert RUNS[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", ["keep_one", "lines", "quality", "quality_keep", "remove_leaks", "redact", "sharding"])
def test_clashing_columns(spark, odd, name):
    extra = odd.withColumns({c: F.lit("own") for c in ("n_lines", "kept", "shard", "slot", "n_spans", "base_failed", "stratum", "n_words", "symbols", "t", "hash", "node", "th", "rule")})
    got = RUNS[name](spark, extra)
    assert got.select("text", "th", "node").where("node = 'own'").count() == RUNS[name](spark, odd).count()


def test_empty_benchmark(spark, odd):
    assert decontam.find(odd, bench(spark, [])).count() == 0


@pytest.mark.parametrize("find", [byte_dedup.find, lambda d: wavelet.write_blobs(d, "unused", WORD)])
def test_ids_that_are_no_numbers_are_refused(spark, find):
    with pytest.raises(TypeError):
        find(spark.createDataFrame([("a", "b")], "doc_id string, text string"))

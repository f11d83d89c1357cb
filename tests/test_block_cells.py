"""Blocks meet in cells: a blob goes to a task once for many pairs, and every pair is looked at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mergewell.operators import clustering, matching


@pytest.mark.parametrize("tile", [1, 4, 32])
def test_each_pair_meets_once(spark, monkeypatch, tile):
    monkeypatch.setattr(matching, "TILE", tile)
    blocks = clustering.checkpointed(spark.range(40).select(F.col("id").cast("int").alias("block"), F.col("id").cast("string").cast("binary").alias("blob")))

    def run(cell):
        met = list(matching._met(cell))
        assert all(cell[n]["blob"].as_py() == str(n).encode() for p in met for n in p)
        yield pa.RecordBatch.from_arrays([pa.array([len(cell)]), pa.array([[{"i": i, "j": j} for i, j in met]], pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())])))], names=["blobs", "met"])

    rows = matching._against(blocks, matching._pairs_of(blocks), run, "blobs long, met array<struct<i:long,j:long>>").collect()
    got = sorted((p.i, p.j) for r in rows for p in r.met)
    assert got == [(i, j) for i in range(40) for j in range(i, 40)]
    # two blobs a pair before
    assert sum(r.blobs for r in rows) < (2 * len(got) if tile == 1 else len(got))

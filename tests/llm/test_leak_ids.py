"""Benchmark items without an id are items all the same."""

import random

from mergewell.llm import decontam
from tests.llm.conftest import docs
from tests.llm.test_brute import prose


def test_items_without_an_id(spark):
    rng = random.Random(12)
    a, b, c = prose(rng, 20), prose(rng, 20), prose(rng, 30)
    texts = [f"{prose(rng, 30)} {a} {prose(rng, 9)}", b, c, prose(rng, 50), f"x {a} y {b}"]
    bench = spark.createDataFrame([(None, a), (None, b), (7, c), (8, c)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontam.find(docs(spark, texts), bench).collect()}
    assert got == {(0, None): (30, 1.0), (1, None): (0, 1.0), (2, 7): (0, 1.0), (2, 8): (0, 1.0), (4, None): (1, 1.0)}
    assert [r.doc_id for r in decontam.remove_leaks(docs(spark, texts), bench).collect()] == [3]

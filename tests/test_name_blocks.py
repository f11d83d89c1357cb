"""Blocks of names against scores of single pairs, and the groups that they connect against those of all matches."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mergewell import catalog
from mergewell.functions import name_blocks
from mergewell.functions import scalars as S
from mergewell.functions import similarity as sim
from mergewell.operators import clustering, matching
from mergewell.operators.normalize import normalize
from mergewell.plans.synthetic import records

SCHEMA = pa.schema([("record_idx", pa.int64()), ("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("companies", pa.list_(pa.string())), ("skills", pa.list_(pa.string())), ("keys", pa.list_(pa.struct([("rule", pa.int32()), ("key", pa.string()), ("first", pa.int64())])))])


def block(names, at=0):
    return name_blocks.Block(pa.Table.from_pylist([{"record_idx": i, "name": n, "first": i, "last": i} for i, n in enumerate(names, at)], schema=SCHEMA))


def test_scores_of_blocks_are_those_of_pairs(monkeypatch):
    monkeypatch.setattr(name_blocks, "CHUNK", 16)
    rng = random.Random(5)
    words = ["anna", "marie", "j", "b", "li", "wu", "smith", "smyth", "katherine", "zoë", "李", "😀x", "x11", "10"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(120)} | {"a" * 80, "a" * 70 + " b", "a" * 64, "a" * 63 + "b", "ada lovelace1", "ada lovelace12"}
    names = sorted(names)
    a, b = block(names[::2]), block(names[1::2], 1000)
    by_set, sort, ab, ba = name_blocks._name_scores(a, b, 0, len(b.names), 71.0)
    for (j, q), (i, p) in itertools.product(enumerate(b.names), enumerate(a.names)):
        s, t, one, two = sim.token_set(p, q), sim.token_sort(p, q), sim.initials(p, q), sim.initials(q, p)
        if max(s, t, one, two) >= 71:
            assert (max(s, one), max(s, two), max(s, t, one)) == (max(by_set[j, i], ab[j, i]), max(by_set[j, i], ba[j, i]), max(by_set[j, i], sort[j, i], ab[j, i])), (p, q)


def test_groups_take_the_least_label():
    groups = name_blocks.Groups(np.array([5, 3, 9]), np.array([4, 8]))
    groups.add(np.array([0, 1]), np.array([0, 0]))
    assert groups.a.tolist() == [3, 3, 9] and groups.b.tolist() == [3, 8]


def test_many_blocks_match_and_connect_as_one(spark, monkeypatch, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey < 60").write.parquet(f"{tmp_path}/customer.parquet")
    rows = normalize(records(spark, str(tmp_path)))
    whole = {tuple(r) for r in matching.matches(rows).collect()}
    monkeypatch.setattr(matching, "BLOCK", 20)
    assert {tuple(r) for r in matching.matches(rows).collect()} == whole
    by_all = clustering.components(rows, matching.matches(rows))
    assert {tuple(r) for r in clustering.components(rows, matching.linked(rows)).collect()} == {tuple(r) for r in by_all.collect()}


def test_ordered_distinct_works_its_items_out_once(spark):
    from pyspark.sql import functions as F

    from mergewell.functions import scalars as S

    df = spark.createDataFrame([(["b", "A", None, "a", "B", "c", None],), (["x"],), ([],), (None,)], "x array<string>")
    out = df.select(S.dedup_ci(F.filter("x", lambda v: v.isNull() | (v != "marker"))).alias("y"))
    assert [r.y for r in out.collect()] == [["b", "A", None, "c"], ["x"], [], None]
    assert out._jdf.queryExecution().analyzed().toString().count("marker") == 1


def test_scored_pairs_work_no_pair_out_by_itself(monkeypatch):
    def alone(*_):
        raise AssertionError("a pair by itself")

    want = {(f"supplier {i:09d}", f"supplier {j:09d}"): sim.token_sort(f"supplier {i:09d}", f"supplier {j:09d}") for i, j in itertools.product(range(95, 110), range(995, 1010))}
    want = {p: max(s, sim.token_set(*p)) for p, s in want.items()}
    for score in ("token_sort", "token_set", "initials", "ratio"):
        monkeypatch.setattr(sim, score, alone)
    a, b = block([f"supplier {i:09d}" for i in range(95, 110)]), block([f"supplier {i:09d}" for i in range(995, 1010)], 20)
    got = {}
    for idx, offsets, others, scores in name_blocks.scored_pairs(a, b, False):
        got |= {(a.names[x], b.names[y - 20]): s for y, x, s in zip(np.repeat(idx, np.diff(offsets)), others, scores, strict=True)}
    assert got == want


def test_name_similarity_is_that_of_pairs(spark, monkeypatch, tmp_path):
    rng = random.Random(7)
    words = ["Anna", "Marie", "J", "b", "Li", "Smith", "Smyth", "Zoë", "10", "#1", "x" * 70]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["", None, "  ", "#", "J Smith", "John S", "John Smith"]
    rows = [(rng.choice([k, 3, 50 - k]), n) for k, n in enumerate(names)] + [(None, "Anna"), (-(2**63), "Anna"), (2**63 - 1, "Li")]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    keyed = spark.createDataFrame(rows, "k bigint, s string").select("k", S.name_key(F.col("s"))).collect()
    score = lambda p, q: max(sim.token_sort(p, q), sim.token_set(p, q), sim.initials(p, q))
    want = sorted((i, j, score(p, q)) for (i, p), (j, q) in itertools.product(keyed, keyed) if i is not None and j is not None and i < j)
    monkeypatch.setattr(matching, "BLOCK", 9)
    df = catalog.q_name_similarity(spark, str(tmp_path))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.dtypes == [("k", "bigint"), ("other", "bigint"), ("score", "double")]
    assert sorted(tuple(r) for r in df.collect()) == want

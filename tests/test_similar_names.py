"""Similarity rules against all pairs of records with misspelt, short and repeated names."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mergewell.functions import similarity as sim
from mergewell.operators import matching, output
from mergewell.operators.normalize import normalize
from tests.test_records import rec

NAMES = ["katherine johnsson", "katharine johnson", "jon smyth", "john smith", "j smith", "ada ada lovelace", "adda lovelase", "bo", "bob", "wu li", "li wu", "grace b hopper", "grase hoper", "g hopper"]


def test_no_pair_is_lost(spark):
    rng = random.Random(1)
    names = list(NAMES)
    for n in NAMES * 6:
        at = rng.randrange(len(n))
        names.append(" ".join((n[:at] + rng.choice(["", "x", n[at] * 2, " "]) + n[at + rng.randrange(2) :]).split()))
    names = sorted({n for n in names if n})
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for floor, sort in ((90.0, True), (71.0, False)):
        got = {(r.l, r.r) for r in matching.similar_names(frame, floor, sort).collect()}
        want = {(a, b) for a, b in itertools.permutations(names, 2) if max(sim.token_set(a, b), sim.initials(a, b), sim.token_sort(a, b) if sort else 0) >= floor}
        assert got == want and len(want) > 20


@pytest.mark.parametrize("floor", [70.0, 86.0, 90.0, 100.0])
@pytest.mark.parametrize("block", [7, 4096])
def test_candidates_hold_every_pair_once(spark, monkeypatch, floor, block):
    monkeypatch.setattr(sim, "BLOCK", block)
    monkeypatch.setattr(sim, "KEYED_FLOOR", 60.0 if floor < 80 else 85.0)
    rng = random.Random(int(floor) + block)
    words = ["anna", "marie", "j", "b", "li", "wu", "smith", "smyth", "katherine", "zoë", "李", "😀x", "x11", "10"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    names += [n[:k] + rng.choice(["", "e", n[k] * 2]) + n[k + rng.randrange(2) :] for n in names for k in [rng.randrange(len(n))]]
    names = sorted({" ".join(n.split()) for n in names} | {"a" * 400, "a" * 390 + "b"})
    left, right = names[::2], [*names[1::2], *names[::6]]
    frame = lambda ns, c: spark.createDataFrame([(n,) for n in [*ns, None, "", "  "]], f"{c} string")
    got = [(x.l, x.r) for x in sim.near_pairs(frame(left, "l"), frame(right, "r"), floor).collect()]
    score = lambda a, b: max(sim.token_set(a, b), sim.token_sort(a, b), sim.initials(a, b))
    want = {(a, b) for a in left for b in right if a.strip() and b.strip() and score(a, b) >= floor}
    assert want <= set(got) and len(got) == len(set(got)) and len(want) > 20


def test_unordered_candidates_hold_pairs_that_one_side_alone_has_keys_for(spark):
    names = ["j smith", "john smith", "jon smyth", "katherine johnsson", "katharine johnson"]
    frame = lambda c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    got = {(x.l, x.r) for x in sim.near_pairs(frame("l"), frame("r"), 90.0, unordered=True).collect()}
    assert {("j smith", "john smith"), ("katharine johnson", "katherine johnsson")} <= got and all(a < b for a, b in got)


def rules(frame):
    return {(r.left, r.right): r.rule for r in frame.collect()}


def test_misspelt_names_match(spark):
    job = lambda c: [f'{{"company":"{c}"}}']
    six = normalize(rec(spark, {"full_name": "Katherine Johnsson"}, {"full_name": "Katharine Johnson"}))
    seven = normalize(rec(spark, {"full_name": "Jon Smyth", "experience": job("Acme")}, {"full_name": "John Smith", "experience": job("Acme")}))
    eight = normalize(rec(spark, {"full_name": "Jon Smyth", "skills": ["Go"]}, {"full_name": "John Smith", "skills": ["Go"]}))
    assert [rules(matching.matches(x)) for x in (six, seven, eight)] == [{(1, 0): 6}, {(1, 0): 7}, {(1, 0): 8}]


def test_resume_with_a_misspelt_name(spark):
    rows = rec(spark, {"full_name": "Katherine Johnsson"}, {"kind": "resume", "full_name": "Katharine Johnson"}, {"full_name": "Bob Ray"})
    found = output.resume_matches(rows.where("source.source_type = 'csv'"), rows.where("source.source_type = 'resume'"))
    assert [tuple(r) for r in found.select("resume_idx", "record_idx", F.col("rule")).collect()] == [(1, 0, 4)]

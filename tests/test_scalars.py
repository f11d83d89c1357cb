"""Scalar functions on cases made from their rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mergewell.functions import scalars as S
from mergewell.functions import similarity


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def check(spark, f, table):
    assert values(spark, f, [x for x, _ in table]) == [y for _, y in table]


def test_email(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcxyz019") for _ in range(rng.randrange(1, 6)))
    good = [f"{word()}{rng.choice(['.', '_', '+', '-', ''])}{word()}@{word()}-{word()}.{'.'.join(word() for _ in range(rng.randrange(1, 4)))}" for _ in range(60)]
    check(spark, S.email, [(f" {g.title()}\t", g) for g in good])
    breaks = [lambda g: g.replace("@", ""), lambda g: g.replace("@", "@@"), lambda g: "." + g, lambda g: g.replace("@", ".@"), lambda g: g.replace("@", "..x@"), lambda g: g.replace("@", "@-"), lambda g: g + "-", lambda g: g + ".", lambda g: g.replace("@", " @"), lambda g: g.split("@")[0] + "@nodot"]
    check(spark, S.email, [(b(g), None) for b in breaks for g in good[:6]] + [(None, None), ("", None), (" \n", None), ("q@w.z", "q@w.z")])


def test_phone(spark):
    rng = random.Random(2)
    own = [f"{rng.randrange(2, 10)}{rng.randrange(10, 100):02d}{rng.randrange(2, 10)}{rng.randrange(10**6):06d}" for _ in range(40)]
    shapes = [lambda n: f"({n[:3]}) {n[3:6]}-{n[6:]}", lambda n: f"+1 {n[:3]}.{n[3:6]}.{n[6:]}", lambda n: f" 1-{n[:3]}-{n[3:]} ", lambda n: n]
    check(spark, S.phone, [(rng.choice(shapes)(n), f"+1{n}") for n in own])
    check(spark, S.phone, [(None, None), ("", None), ("call me", None), ("77", None), ("+1 1" + own[0][1:], None), ("+000 5551234567", None)])
    assert values(spark, lambda c: S.phone(c, "GB"), ["020 8765 4321"]) == ["+442087654321"]
    check(spark, S.phone_key, [("55-66", "5566"), ("none", None)])


def test_date(spark):
    rng, rows = random.Random(3), []
    for _ in range(30):
        d = datetime.date(1950, 1, 1) + datetime.timedelta(days=rng.randrange(40_000))
        rows += [(f" {d.year}", f"{d.year}"), (f"{d:%B} {d.year}", f"{d:%Y-%m}"), (f"{d:%b} {d.year}".upper(), f"{d:%Y-%m}"), (f"{d.month}/{d.year}", f"{d:%Y-%m}"), (d.isoformat(), d.isoformat()), (f"{d:%m/%d/%Y}", d.isoformat()), (f"{d:%B} {d.day}, {d.year}", d.isoformat()), (f"{d.day} {d:%b} {d.year}", d.isoformat())]
        if d.day > 12:
            rows += [(f"{d:%d/%m/%Y}", d.isoformat()), (f"{d:%d-%m-%Y}", d.isoformat())]
    check(spark, S.date, rows + [(b, None) for b in (None, "", "\t", "today", "1899", "2101", "2020-13", "31/31/2020", "Foo 2020")])


def test_skill_and_lists(spark):
    check(spark, S.skill, [("PY", "Python"), ("js ", "JavaScript"), ("Node_JS", "Node.js"), ("C  minus", "C minus"), ("\t", None), (None, None)])
    assert values(spark, S.skills, [["python 3", "go", "Python", "", "GO"]], "array<string>") == [["Python", "go"]]
    rng = random.Random(4)
    lists = [[rng.choice("aAbBcCßSs") + rng.choice(["", "x"]) for _ in range(rng.randrange(12))] for _ in range(60)]
    fold = lambda x: x.lower().replace("ß", "ss")
    assert values(spark, S.dedup_ci, lists, "array<string>") == [list({fold(x): x for x in reversed(v)}[k] for k in dict.fromkeys(map(fold, v))) for v in lists]


def test_location(spark):
    got = values(spark, S.location, ["Graz , Styria,  Austria", "Leeds, York, U.K.", "Quito", "", " , ,", None])
    assert [tuple(g)[:3] if g else None for g in got][1:] == [("Leeds", "York", "United Kingdom"), ("Quito", None, None), None, None, None]
    assert got[0]["city"] == "Graz"


def test_links(spark):
    got = values(spark, S.link, ["www.github.com/zed", "HTTPS://LinkedIn.com/in/zed", "youtube.com/z", "http://zed.example", "mailto:z", "z z", "  ", None])
    assert [g and g["category"] for g in got] == ["github", "linkedin", "other", "portfolio", None, None, None, None]
    check(spark, S.url_key, [("HTTP://www.Zed.org/A/b//?x#y", "zed.org/a/b"), ("www.zed.org", "zed.org"), ("zed.org/a", None)])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similarity():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(0, 14))) for _ in "ab")
        assert similarity.ratio(a, b) == (200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0)
        assert similarity.token_sort(a, b) == similarity.token_sort(b, " ".join(reversed(a.split())))


@pytest.mark.parametrize(("a", "b", "score"), [("mira k", "mira kowalska", 95), ("mira kowalska", "mira k", 0), ("ivo petrov", "petrov ivo", 95), ("ivo p", "ivo von petrov", 90), ("ana", "ivo", 0), ("", "", 0)])
def test_initials(a, b, score):
    assert similarity.initials(a, b) == score

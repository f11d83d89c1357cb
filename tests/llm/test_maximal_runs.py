"""Maximal repeated runs of lines against brute force over all pairs of places."""

import random
import re

import corpus_pipeline
from mergewell.llm import line_dedup
from tests.llm.conftest import docs
from tests.llm.test_brute import prose


def maximal_by_brute_force(texts, words=8):
    split = [(t or "").split("\n") for t in texts]
    places = [(d, i) for d, lines in enumerate(split) for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    line = lambda p: split[places[p][0]][places[p][1]]
    gone = set()
    for a in range(len(places)):
        for b in range(a):
            k = 0
            while a + k < len(places) and places[a + k][0] == places[a][0] and places[b + k][0] == places[b][0] and line(a + k) == line(b + k):
                k += 1
            if sum(len(line(a + j).split()) for j in range(k)) >= words:
                gone.update(places[a + j] for j in range(k))
    return ["\n".join(x for i, x in enumerate(lines) if (d, i) not in gone) for d, lines in enumerate(split)]


def test_maximal_runs(spark):
    rng = random.Random(6)
    pool = [prose(rng, n, 50) for n in (1, 1, 2, 2, 3, 3, 4, 5, 9, 12)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += [texts[0], texts[5] + "\none two", "\n".join(pool[0] for _ in range(30)), "\n".join(pool[0] for _ in range(40))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts), maximal=True).collect()}
    assert [got[i] for i in range(len(texts))] == maximal_by_brute_force(texts)


def test_short_lines_behind_a_long_one_go_too(spark):
    rng = random.Random(7)
    a, b, c = prose(rng, 25), prose(rng, 3), prose(rng, 4)
    texts = ["\n".join((a, b, c, "one ending")), "\n".join((a, b, c, "another")), "\n".join((a, b, c))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts), maximal=True).collect()}
    assert [got[i].text for i in range(3)] == [texts[0], "another", ""]
    assert [(got[i].n_removed, got[i].n_runs) for i in range(3)] == [(0, 0), (3, 1), (3, 1)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_runs(spark, docs(spark, texts), "").collect()}
    assert kept == {0: texts[0], 1: "another"}

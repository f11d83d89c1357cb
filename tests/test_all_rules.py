"""The registered queries of all match rules against brute force over all pairs of a small customer table."""

import itertools

import pytest

from mergewell import catalog
from mergewell.functions import similarity as sim

KEYS = range(10, 34)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("all_rules"))
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where(f"c_custkey between {KEYS[0]} and {KEYS[-1]}").write.parquet(f"{path}/customer.parquet")
    return path


def people():
    """record_idx -> (key, name, company, skills) of the records that have a name, by the rules of plans.synthetic."""
    skills = ({"python", "sql"}, {"javascript", "docker"}, {"node.js", "python"}, {"spark", "python"})
    out = {}
    for k in KEYS:
        name = f"{('ada', 'grace', 'alan', 'edsger', 'barbara')[k % 5]} lovelace{k}"
        out[4 * k] = (k, name, True, skills[k % 4])
        if k % 2 == 0:
            out[4 * k + 1] = (k, name, False, {"kafka", "python"})
    return out


def test_all_rules(spark, small):
    segment = {r.c_custkey: r.c_mktsegment.lower() for r in spark.read.parquet(f"{small}/customer.parquet").collect()}
    want = {}
    for (right, a), (left, b) in itertools.combinations(sorted(people().items()), 2):
        if a[0] == b[0]:
            continue  # by e-mail, a rule on shared keys
        n = max(sim.token_set(b[1], a[1]), sim.initials(b[1], a[1]))
        if max(n, sim.token_sort(b[1], a[1])) >= 90:
            want[left, right] = 6
        elif a[2] and b[2] and 0.65 * n + 0.35 * sim.token_set(segment[b[0]], segment[a[0]]) >= 85:
            want[left, right] = 7
        elif a[3] & b[3] and 0.7 * n + 30 * len(a[3] & b[3]) / min(len(a[3]), len(b[3])) >= 80:
            want[left, right] = 8
    rows = catalog.q_match_all_rules(spark, small).collect()
    got = {(r.left_idx, r.right_idx): r.rule for r in rows if r.rule >= 6}
    # rule 6 joins any later record of a name to the first of another: its pairs are some of the brute force's
    assert all(want.get(p) == 6 for p, rule in got.items() if rule == 6)
    names = lambda pairs: {frozenset((people()[a][0], people()[b][0])) for a, b in pairs}
    assert names(p for p in got if got[p] == 6) == names(p for p in want if want[p] == 6)
    assert {p for p in got if got[p] > 6 and want.get(p) != 6} == {p for p in want if want[p] > 6}

    root = {r.left_idx: r.left_idx for r in rows} | {r.right_idx: r.right_idx for r in rows}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    by_key = [(4 * k + o, 4 * k) for k in KEYS for o, every in ((1, 2), (2, 5), (3, 7)) if k % every == 0]
    for a, b in [*want, *by_key]:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    clusters = {r.record_idx: r.cluster_id for r in catalog.q_components_all_rules(spark, small).collect()}
    assert clusters == {i: top(i) for i in clusters} and len(set(clusters.values())) < len(KEYS)
    assert catalog.q_merged_all_rules(spark, small).count() == len(set(clusters.values()))
    assert catalog.entry(spark, small).count() == len(set(clusters.values()))


def test_name_similarity_scores_all_pairs(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert catalog.q_name_similarity(spark, "/root/testdata/sf0.001").count() == n * (n - 1) // 2

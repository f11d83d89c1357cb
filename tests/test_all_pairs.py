"""Every pair that meets a rule is listed, not only those that connect the same clusters."""

import itertools

from mergewell import catalog
from mergewell.functions import similarity as sim
from mergewell.operators import matching
from mergewell.operators.normalize import normalize
from tests.test_all_rules import KEYS, people, small  # noqa: F401
from tests.test_records import rec


def test_all_pairs_of_like_names_and_keys(spark, small):  # noqa: F811
    segment = {r.c_custkey: r.c_mktsegment.lower() for r in spark.read.parquet(f"{small}/customer.parquet").collect()}
    want = {(4 * k + o, 4 * k): rule for k in KEYS for o, every, rule in ((1, 2, 1), (2, 5, 3), (3, 7, 2)) if k % every == 0}
    for (right, a), (left, b) in itertools.combinations(sorted(people().items()), 2):
        n = max(sim.token_set(b[1], a[1]), sim.initials(b[1], a[1]))
        if (left, right) in want:
            continue
        if max(n, sim.token_sort(b[1], a[1])) >= 90:
            want[left, right] = 6
        elif a[2] and b[2] and 0.65 * n + 0.35 * sim.token_set(segment[b[0]], segment[a[0]]) >= 85:
            want[left, right] = 7
        elif a[3] & b[3] and 0.7 * n + 30 * len(a[3] & b[3]) / min(len(a[3]), len(b[3])) >= 80:
            want[left, right] = 8
    rows = catalog.q_match_all_rules(spark, small).collect()
    assert len(rows) == len(want) and {(r.left_idx, r.right_idx): r.rule for r in rows} == want


def test_all_pairs_of_a_key_and_a_name(spark):
    named = [{"full_name": n} for n in ("Ada King", "ada king", "Ada Kings", "ada kings")]
    rows = normalize(rec(spark, *named, *[{"emails": ["a@x.org"], "full_name": n} for n in (None, "Bo Li", None)]))
    got = {(r.left, r.right): r.rule for r in matching.matches(rows, complete=True).collect()}
    assert got == {(j, i): 6 for i, j in itertools.combinations(range(4), 2)} | {(j, i): 1 for i, j in itertools.combinations(range(4, 7), 2)}

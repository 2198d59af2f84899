import random
from datetime import date, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.operators.knowntime import PersistentTree, as_known

D0 = date(2020, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(-1, 14))
def test_tree_versions_equal_a_scan(ranks, key):
    tree = PersistentTree(np.array(ranks), 13)
    roots = np.arange(len(ranks))
    got = tree.predecessor(roots, np.full(len(ranks), key))
    for v in roots:
        seen = {r: i for i, r in enumerate(ranks[: v + 1])}
        best = max((r for r in seen if r <= key), default=None)
        assert got[v] == (-1 if best is None else seen[best])


def brute(events, facts):
    out = set()
    for e, d in events:
        if e is None or d is None:
            continue
        best = {}
        for ent, attr, valid, known, fid in facts:
            if None in (ent, attr, valid, known, fid) or ent != e or valid > d or known > d:
                continue
            k = (valid, known, -fid)
            best[attr] = max(best.get(attr, k), k)
        out |= {(e, d, a, -k[2]) for a, k in best.items()}
    return out


def test_equals_brute_force_with_nulls_ties_and_repeats(spark):
    rnd = random.Random(5)
    day = lambda: rnd.choice([None, *[D0 + timedelta(days=rnd.randrange(7000)) for _ in range(9)]])
    facts = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice(["a", "b", None]), day(), day(), rnd.randrange(40)) for _ in range(400)]
    facts += facts[:50]
    events = [(rnd.choice([1, 2, 3, None]), day()) for _ in range(200)]
    f = spark.createDataFrame([(*x, "extra") for x in facts], "entity bigint, attr string, valid date, known date, fact_id bigint, shard string")
    e = spark.createDataFrame([(*x, 9) for x in events], "entity bigint, day date, kind int")
    got = {(r.entity, r.day, r.attr, r.fact_id) for r in as_known(e, f).collect()}
    assert got == brute(events, facts)


def test_empty_sides(spark):
    f = spark.createDataFrame([], "entity bigint, attr string, valid date, known date, fact_id bigint")
    e = spark.createDataFrame([(1, D0)], "entity bigint, day date")
    assert as_known(e, f).count() == 0
    one = spark.createDataFrame([(1, "a", D0, D0, 5)], f.schema)
    assert as_known(e.where("false"), one).count() == 0
    assert [r.fact_id for r in as_known(e, one).collect()] == [5]

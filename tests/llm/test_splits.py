"""Groups against union-find; splits whole and in proportion."""

import random

from cardlake.llm import splits


def union_find(rows):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    good = [(s, d) for s, d in rows if s and s.strip() and d]
    for s, d in good:
        up[top(("s", s))] = top(("d", d))
    groups = {}
    for s, d in good:
        g = groups.setdefault(top(("s", s)), (set(), set()))
        g[0].add(s)
        g[1].add(d)
    return {(s, min(g[1])) for g in groups.values() if len(g[0]) > 1 for s in g[0]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "sessionId string, seed bigint")


def found(spark, rows):
    return {(r.sessionId, r.groupSeed) for r in splits.bound_sessions(frame(spark, rows)).collect()}


def test_random_graphs(spark):
    r = random.Random(4)
    rows = [(f"s{r.randint(0, 60)}", r.choice([None, 0, *range(1, 70)])) for _ in range(160)]
    assert found(spark, rows) == union_find(rows)


def test_long_chain_hot_seed_and_negative_seeds(spark):
    chain = [(f"c{i}", s) for i in range(25) for s in (100 + i, 101 + i)]
    hot = [(f"h{i}", 7) for i in range(80)] * 2
    rows = chain + hot + [("n1", -5), ("n2", -5)]
    assert found(spark, rows) == union_find(rows)


def test_missing_values_join_nothing(spark):
    assert found(spark, [(None, 1), ("", 1), (" ​", 1), ("a", 1), ("b", 0), ("c", 0), ("d", None), ("e", None)]) == set()
    assert found(spark, []) == set()


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(9)
    rows = [(f"s{r.randint(0, 400)}", r.choice([None, *range(1, 300)])) for _ in range(2000)] + [(None, 3), ("", 4)]
    df = frame(spark, rows)
    out = {x.sessionId: (x.groupSeed, x.split) for x in splits.assign_splits(df).collect()}
    assert set(out) == {s for s, _ in rows if s}
    group = {}
    for g, s in out.values():
        if g is not None:
            assert group.setdefault(g, s) == s
    again = {x.sessionId: (x.groupSeed, x.split) for x in splits.assign_splits(df.repartition(5)).collect()}
    assert again == out


def test_proportions_of_many_small_groups(spark):
    df = frame(spark, [(f"s{i}", i + 1) for i in range(3000)])
    n = {}
    for x in splits.assign_splits(df).collect():
        n[x.split] = n.get(x.split, 0) + 1
    assert abs(n["train"] / 3000 - 0.8) < 0.01 and abs(n["test"] / 3000 - 0.1) < 0.01


def test_components_of_loops_and_repeats(spark):
    e = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None)], "u bigint, v bigint")
    assert sorted(tuple(r) for r in splits.components(e).collect()) == [(2, 2), (3, 2)]

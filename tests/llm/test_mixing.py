from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from melisma.llm import mixing as M

from .helpers import docs, words


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(w[s] for s in left), 1e-9)
        over = [s for s in left if w[s] * share > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * share for s in left}
        fixed |= {s: most * sizes[s] for s in over}


SIZES = T.StructType([T.StructField("source", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("source_size", T.LongType())])


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1, "B": 0, "é": 7, None: 100, "c": 5, "d": 3}, {"x": 5}, {"x": 0, "y": 0}])
def test_targets(spark, sizes):
    got = M.targets(spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], SIZES)).collect()
    want = brute_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) for r in got) and len(got) == len(want)


def test_tree_is_exact_and_fair(spark):
    quotas = {0: 1000, 1: 37, 2: 1, 3: 0, 4: 562}
    df = spark.createDataFrame(list(quotas.items()), "ix long, quota long")
    shares = []
    for seed in range(20):
        leaves = M.splitting_tree(df, 3, seed).collect()
        at = defaultdict(list)
        per = Counter()
        for r in leaves:
            at[r.ix].append((r.start, r.n))
            per[r.shard] += r.n
        for ix, q in quotas.items():  # disjoint ranges that cover the quota
            ranges = sorted(at[ix])
            assert sum(n for _, n in ranges) == q
            assert all(a + n == b for (a, n), (b, _) in zip(ranges, ranges[1:], strict=False))
        assert set(per.values()) == {200} and len(per) == 8
        shares += [sum(r.n for r in leaves if r.ix == 0 and r.shard == k) for k in range(8)]
    mean = sum(shares) / len(shares)
    var = sum((x - mean) ** 2 for x in shares) / len(shares)
    p = 1000 / 1600
    assert mean == 125 and 0.6 < var / (200 * p * (1 - p) * (1400 / 1599)) < 1.5  # of the hypergeometric law


def corpus():
    rows = [(i, f"w{i % 5} " * (1 + i % 23), "en", f"s{i % 4}" if i % 3 else "big") for i in range(900)]
    return [*rows, (2000, None, "en", "s1"), (2001, "", "en", None), (2002, "a b c", "en", None), (2003, "x " * 30000, "en", "s2"), (None, "q q", "en", "big"), (5, "twice here", "en", "s9"), (5, "twice here", "en", "s9")]


def test_mix(spark):
    rows = corpus()
    table = docs(spark, rows, extra=True)
    got = M.plan(table, block_docs=8, shard_blocks=8).collect()
    assert len(got) == len(rows)
    size, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.size * len(r.draws)
        largest[r.source] = max(largest[r.source], r.size)
        assert len(r.draws) <= 3 and len({d.epoch for d in r.draws}) == len(r.draws)
    assert {r.doc_id: r.size for r in got}[2003] == 30000 and {r.doc_id: r.size for r in got}[2000] == 0
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1 if r[0] is not None else -1, len(words(r[1]))) for r in rows)
    want = brute_targets({s: float(n) for s, n in size.items()})
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
    again = M.plan(table.repartition(7), block_docs=8, shard_blocks=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_and_empty(spark):
    table = docs(spark, corpus(), extra=True)
    out = M.mixed_rows(table, block_docs=8, shard_blocks=8)
    assert out.columns == table.columns
    assert out.count() == sum(len(r.draws) for r in M.plan(table, block_docs=8, shard_blocks=8).collect())
    assert M.plan(docs(spark, [])).count() == 0
    assert [len(r.draws) for r in M.plan(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]

import numpy as np
from pyspark.sql import types as T

from melisma.llm import hnsw as H

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_against_brute_force_with_edges(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = [(i, base[i % 60] + rng.normal(size=16) * (0.15 if i >= 60 else 0)) for i in range(400)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in rows]
    rows += [(500 + i, rows[3][1]) for i in range(50)]  # copies
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] + [1.0] * 15), (605, [float("inf")] * 16), (606, rows[5][1][:8]), (607, rows[5][1][:8]), (None, rows[7][1]), (608, rows[9][1]), (608, rows[9][1]), (609, [x * 1000 for x in rows[11][1]])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], SCHEMA).withColumnRenamed("label", "cid")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in H.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_wide_beams_and_large_groups():
    rng = np.random.default_rng(1)
    x = H._unit(np.concatenate((rng.normal(size=(1500, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(700, 24)))))
    g = H.Graph(x.astype(np.float32))
    own = np.arange(len(x))[::3]
    links, recall = H.find_links(g, x, x[::3], own)
    got = {(i, j) for a, b in links for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    truth = {(i, j) for i, j in zip(*np.nonzero(x[::3] @ x.T >= 0.9), strict=True) if own[i] != j}
    assert recall >= H.AUDIT_RECALL and got <= truth and len(got) >= 0.99 * len(truth)


def test_all_pairs_where_no_beam_passes(monkeypatch):
    rng = np.random.default_rng(2)
    x = H._unit(np.repeat(rng.normal(size=(400, 8)), 2, axis=0) + 0.01 * rng.normal(size=(800, 8)))
    g = H.Graph(x.astype(np.float32))
    for layer in g.near:
        layer[:] = g.n  # a graph without links finds nothing
    links, recall = H.find_links(g, x, x, np.arange(800), beam=8)
    got = {(i, j) for a, b in links for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert recall < H.AUDIT_RECALL and got == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i != j}


def test_audits_look_for_rare_partners(monkeypatch):
    rng = np.random.default_rng(3)
    x = H._unit(rng.normal(size=(3000, 32)))
    x[2999] = x[0] + 1e-3
    x = H._unit(x)
    got = H.audit_sample(x, x, np.arange(3000), 0.9)
    assert sorted((i, c.tolist()) for i, c in got) == [(0, [2999]), (2999, [0])]


def test_empty(spark):
    assert H.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = H.near_duplicates(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(1, 0, 1)]

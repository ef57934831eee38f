import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from melisma.llm import toxicity as T

from .helpers import docs


def test_features_by_hand():
    one, same, other = T.feature_lists(pa.array(["Bad dog, runs", "bad  dog runs", "bad cat runs"]))
    assert np.array_equal(one, same)
    assert len(one) == 6  # three words, two pairs, one skip pair
    assert len(np.intersect1d(one, other)) == 3  # bad, runs, bad_runs
    assert [len(x) for x in T.feature_lists(pa.array([None, "", "...", "a"], pa.string()))] == [0, 0, 0, 1]


def test_packing_of_coordinates():
    for x in ([], [0], [5, 6, 70000, 1048575], list(range(0, 1048576, 999))):
        assert T.unpacked(memoryview(T.packed(np.array(x, np.int32)))).tolist() == x


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        ws = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(["vile", "scum"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    table = docs(spark, [*rows, (5000, None), (5001, ""), (5002, "vile " * 50000), (None, "w1 w2"), (0, rows[0][1])], extra=True)
    known = spark.createDataFrame([*labels, (9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = T.fit(table, known)
    assert len(model.index) < 200
    score = T.scorer(spark, model)
    got = {r.doc_id: r.s for r in table.select("doc_id", score("text").alias("s")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= T.THRESHOLD) == bool(dict(labels)[i]) for i in held]) > 0.97
    assert got[5000] == got[5001] < T.THRESHOLD and got[5002] > T.THRESHOLD


def test_without_labels(spark):
    table = docs(spark, [(1, "a b")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    score = T.scorer(spark, T.fit(table, none))
    assert [r.s < 0.01 for r in table.select(score("text").alias("s")).collect()] == [True]
    assert docs(spark, []).select(score("text")).count() == 0


def plain_ftrl(rows, labels, epochs, seed):
    """FTRL-proximal one coordinate after the other, by its textbook update."""
    base = sum(labels) / len(labels)
    bias, bias_n = math.log(base / (1 - base)), 0.0
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= T.L1 else (math.copysign(T.L1, z[i]) - z[i]) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            x = [int(i) for i in rows[r]]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-(bias + sum(w.values()))))
            g = p - labels[r]
            for i in x:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / T.ALPHA * w[i]
                n[i] = old + g * g
            bias_n += g * g
            bias -= T.ALPHA / (T.BETA + math.sqrt(bias_n)) * g
    return bias, {i: weight(i) for i in z if weight(i)}


def test_fit_and_scores_against_plain_loops(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) + (" vile scum" if i % 4 == 0 else "") for i in range(300)]
    labels = [int(i % 4 == 0 and i % 16 > 0) for i in range(300)]
    features = T.feature_lists(pa.array(texts))
    bias, weights = plain_ftrl(features, labels, T.EPOCHS, 7)
    model = T.fit_ftrl([T.packed(x) for x in features], np.array(labels, float))
    assert model.bias == pytest.approx(bias) and model.index.tolist() == sorted(weights)
    assert model.weight.tolist() == pytest.approx([weights[i] for i in sorted(weights)], rel=1e-5)
    table = docs(spark, list(enumerate(texts)))
    score = T.scorer(spark, model)
    for r in table.select("doc_id", score("text").alias("s")).collect():
        margin = bias + sum(weights.get(int(i), 0.0) for i in features[r.doc_id])
        assert r.s == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-5)
    # the distributed fit learns from the same rows in the order of their ids, outside the held-out fold
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    mine = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    bias, weights = plain_ftrl([features[i] for i in mine], [labels[i] for i in mine], T.EPOCHS, 7)
    found = T.fit(table.repartition(7), known.repartition(3))
    assert found.bias == pytest.approx(bias) and found.index.tolist() == sorted(weights)

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, adjacent pairs and pairs around one skipped word (lower case; letters and
digits only), hashed into 2**BITS coordinates. Every coordinate has its own learning rate, and the L1 term keeps most
weights at exactly zero, so the model that goes to the executors is a short list of coordinates and weights.

The model is fitted on at most MAX_TRAIN labelled ids (all of them if there are no more), picked by a hash of the id, in
one task; scoring covers every whole text.

Edge cases: null and empty texts score as the bias alone. Labels that are null teach nothing; an id labelled twice
counts as toxic if any of its labels says so; of rows with the same id one teaches, and each is scored. A null id is
in no held-out fold. Without labels of both
kinds the model has no weights and every score is the share of toxic labels (0 without labels). Other columns of the
tables are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 20
#: The bound of the fitting sample, in labelled ids (met on average: they are picked by a hash).
MAX_TRAIN = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
THRESHOLD = 0.3
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[i for i in range(128) if not chr(i).isalnum()]] = 32
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Model:
    bias: float
    index: np.ndarray  # sorted coordinates with a weight
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def _coordinates(t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(owning text, coordinate) of all words, pairs and skip pairs, repeats included."""
    t = C.Texts(_TO_SPACE[t.raw], t.bounds)
    starts, ends, at = t.word_spans()
    h = t.hashes(starts, ends)
    owner = np.repeat(np.arange(len(t)), np.diff(at))
    owners, coords = [owner], [C.mix64(h + _SALTS[0])]
    for gap in (1, 2):
        a, b = h[: max(0, len(h) - gap)], h[gap:]
        same = owner[: len(a)] == owner[gap:]
        owners.append(owner[: len(a)][same])
        coords.append(C.mix64(a[same] * _SALTS[gap] + b[same]))
    return np.concatenate(owners), (np.concatenate(coords) >> np.uint64(64 - BITS)).astype(np.int64)


def feature_lists(column: pa.Array) -> list[np.ndarray]:
    """The distinct coordinates of each text, sorted."""
    out: list[np.ndarray] = []
    for _, _, t in C.text_steps(pc.utf8_lower(column)):
        owner, coord = _coordinates(t)
        pairs = np.unique((owner << BITS) | coord)
        cuts = np.searchsorted(pairs, np.arange(len(t) + 1, dtype=np.int64) << BITS)
        out += [(pairs[x:y] & ((1 << BITS) - 1)).astype(np.int32) for x, y in zip(cuts, cuts[1:], strict=False)]
    return out


def score_texts(column: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    parts = []
    for _, _, t in C.text_steps(pc.utf8_lower(column)):
        owner, coord = _coordinates(t)
        hit = dense[coord] != 0
        pairs = np.unique((owner[hit] << BITS) | coord[hit])
        parts.append(np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)].astype(np.float64), len(t)))
    margin = model.bias + (np.concatenate(parts) if parts else np.zeros(0))
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def packed(x: np.ndarray) -> bytes:
    """Sorted coordinates as differences, in two bytes each where they fit."""
    step = np.diff(x, prepend=0)
    wide = len(step) and step.max() > 0xFFFF
    return (b"4" if wide else b"2") + step.astype("<u4" if wide else "<u2").tobytes()


def unpacked(b: bytes | memoryview) -> np.ndarray:
    return np.cumsum(np.frombuffer(b[1:], "<u4" if b[:1] == b"4" else "<u2"), dtype=np.int64)


def fit_ftrl(rows: list, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """One pass after the other over the rows (coordinates, or those packed); the bias is learned without L1."""
    base = float(labels.mean()) if len(labels) else 0.0
    none = np.zeros(0, np.int64)
    if not 0 < base < 1:
        return Model(float(np.clip(np.log(max(base, 1e-9) / max(1 - base, 1e-9)), -20, 20)), none, none.astype(np.float32))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = float(np.log(base / (1 - base))), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i] if isinstance(rows[i], np.ndarray) else unpacked(rows[i])
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - labels[i]
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    live = np.flatnonzero(np.abs(z) > L1)
    w = (np.sign(z[live]) * L1 - z[live]) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return Model(bias, live, w.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, folds: int = 4, held_out: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents outside the held-out fold."""
    C.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if held_out is not None:
        known = known.where(C.fold("doc_id", folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, max_train / max(total, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # as many ids as the bound of the sample
    joined = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(x) for x in feature_lists(b.column(2))], pa.binary())], names=["doc_id", "toxic", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("x", pa.binary())]))
        y, ids = got.column("toxic").to_numpy().astype(np.float64), got.column("doc_id").to_pylist()
        rows = [memoryview(v.as_buffer()) for v in got.column("x")]  # the table's own memory
        order = sorted(range(len(rows)), key=lambda i: ids[i])
        m = fit_ftrl([rows[i] for i in order], y[order] if len(y) else y)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.index.astype("<i8").tobytes()], pa.binary()), pa.array([m.weight.astype("<f4").tobytes()], pa.binary())], names=["bias", "coords", "weight"])

    # one row an id, so no more than ids were picked; one task learns from them, and the driver sees the weights alone
    sample = joined.mapInArrow(features, "doc_id long, toxic int, x binary").groupBy("doc_id", "toxic").agg(F.min("x").alias("x"))
    found = sample.select("doc_id", "toxic", "x").repartition(1).mapInArrow(train, "bias double, coords binary, weight binary").collect()
    if not found:
        return fit_ftrl([], np.zeros(0))
    return Model(found[0].bias, np.frombuffer(found[0].coords, "<i8"), np.frombuffer(found[0].weight, "<f4"))


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to its score column; the weights travel as one broadcast of a bounded size."""
    C.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    cache: dict[str, np.ndarray] = {}

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        dense = cache.setdefault("w", m.dense())
        for column in batches:
            yield pa.array(score_texts(column, m, dense), pa.float64())

    def score(text: Column | str) -> Column:
        return toxicity((F.col(text) if isinstance(text, str) else text).cast("string"))

    return score


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    score = scorer(spark, fit(docs, C.table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", F.coalesce(C.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language by rank-order profiles.

Each language's profile lists its PROFILE most frequent letter n-grams (1 to 3 letters, word edges included) by falling
frequency over a bounded sample of labelled documents. A document's most frequent n-grams are ranked alike, and the
out-of-place distance to a profile sums, over the document's n-grams, how far each stands from its place there
(PROFILE for n-grams that the profile lacks). The nearest profile gives the language.

Edge cases: a null text, or one without a letter, is `und` with score 0. Ties in frequency go by the n-gram's code
points, ties in distance to the language name that sorts first. Null labels teach nothing; without labelled documents
every text is `und`; a null id is in no held-out fold. Repeated rows are each predicted. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PROFILE = 400
#: The bound of the fitting sample: documents a language (met on average; rows are picked by a hash of the id).
MAX_PER_LANG = 2_000
#: Labels that are learned: those of the most documents.
MAX_LANGS = 500
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.int64)
    found = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.int64)
    out[found] = found
    return out


def _codes(t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Letters with single spaces around words, and the bounds of the texts in it."""
    points = np.frombuffer(t.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(t.raw) + 1, np.int64)
    np.cumsum((t.raw & 0xC0) != 0x80, out=heads[1:])
    bounds = heads[t.bounds]
    return _letters()[points], bounds


def ngrams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one text, packed 21 bits a letter; codes has letters and spaces."""
    c = np.concatenate(([32], codes, [32]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))


def ranked(codes: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams of a text, in order."""
    found, n = np.unique(ngrams(codes), return_counts=True)
    if len(found) > k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        keep = n >= least
        found, n = found[keep], n[keep]
    return found[np.argsort(-n, kind="stable")][:k]


@dataclass(frozen=True)
class Profiles:
    langs: tuple[str, ...]  # sorted
    grams: np.ndarray  # all profiles' n-grams, sorted
    places: np.ndarray  # of each n-gram in each language; PROFILE where absent

    def distances(self, top: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        place = np.where((self.grams[at] == top)[:, None], self.places[at], PROFILE)
        mine = np.arange(len(top))[:, None]
        return np.where(place == PROFILE, PROFILE, np.abs(place - mine)).sum(0)


def predict(column: pa.Array, p: Profiles) -> tuple[list[str], np.ndarray]:
    langs, scores = [], []
    for _, _, t in C.text_steps(pc.utf8_lower(column)):
        codes, bounds = _codes(t)
        b = bounds.tolist()
        for x, y in zip(b, b[1:], strict=False):
            one = codes[x:y]
            if not p.langs or not (one != 32).any():
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            top = ranked(one)
            d = p.distances(top)
            best = int(np.argmin(d))
            langs.append(p.langs[best])
            scores.append(1 - d[best] / (PROFILE * len(top)))
    return langs, np.array(scores, np.float64)


def fit(docs: DataFrame, folds: int = 3, held_out: int | None = 1, max_per_lang: int = MAX_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages named in documents outside the held-out fold; counted on the executors."""
    C.ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    if held_out is not None:
        known = known.where(F.coalesce(C.fold("doc_id", folds), F.lit(-1)) != held_out)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(max_per_lang)) / F.col("n")).alias("share"))
    # as many rows as languages, MAX_LANGS at most
    picked = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(owners.tolist())):
                parts = []
                for _, _, t in C.text_steps(pc.utf8_lower(batch.column(1).filter(pa.array(owners == lang)))):
                    codes, bounds = _codes(t)
                    b = bounds.tolist()
                    parts += [ngrams(codes[x:y]) for x, y in zip(b, b[1:], strict=False)]
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = picked.mapInArrow(count, "lang string, gram long, n long").where(F.col("gram") != ((32 << 21) | 32)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))) - 1
    rows = counted.withColumn("place", place).where(F.col("place") < PROFILE).select("lang", "gram", "place").collect()
    langs = tuple(sorted({r.lang for r in rows}))
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    places = np.full((len(grams), len(langs)), PROFILE, np.int64)
    for r in rows:
        places[np.searchsorted(grams, r.gram), langs.index(r.lang)] = r.place
    return Profiles(langs, grams, places)


def identifier(spark: SparkSession, profiles: Profiles):
    """A function from a text column to struct(lang_pred, score). The profiles have PROFILE rows a language at most."""
    C.ship(spark)
    shared = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            langs, scores = predict(column, shared.value)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    def identify(text: Column | str) -> Column:
        return language((F.col(text) if isinstance(text, str) else text).cast("string"))

    return identify


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    identify = identifier(spark, fit(docs))
    got = docs.select("doc_id", F.coalesce(C.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), identify("text").alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")

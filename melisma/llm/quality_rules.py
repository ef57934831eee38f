"""Quality rules judged by host.

Each document gets counts from its whole text and a base verdict. Rule failures are then summed by host, each host's
failure rate is shrunk toward the corpus by a beta prior fitted to all hosts, and the verdicts on hosts come back to
the documents: a document stays if it passes the base rules and its host isn't rejected. The verdict is relative to the
corpus: hosts that differ by chance alone are shrunk together and none of them goes, one that fails several times as
often as the rest does.

Edge cases: a null or empty text has no words, so its base rules fail. A null host is a host of its own, which is never
rejected as a whole (it names nothing). Repeated rows and ids are judged row by row. An empty table gives no rows.
Columns besides the named three are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A host is rejected if its shrunk failure rate is above so many times the corpus's, but not below the first of these
#: rates and always above the second.
HOST_MULTIPLE, HOST_RATES = 3.0, (0.2, 0.5)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


def repeated_words(h: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words, per text, that lie in a window of words found twice or more in the text. h: word hashes; at: first words."""
    n = len(h)
    if n < window:
        return np.zeros(len(at) - 1, np.int64)
    w, span = h, 1
    while span < window:  # windows of 2, 4, 8 words
        w = C.mix64(w[: len(w) - span] * np.uint64(0x9E3779B97F4A7C15) + w[span:])
        span *= 2
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = owner[: n - window + 1] == owner[window - 1 :]  # windows within one text
    starts = np.flatnonzero(whole)
    keys = C.mix64(w[starts] + owner[starts].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(at) - 1, np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = starts[twice[place] == keys]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    total = np.zeros(n + 1, np.int64)
    np.cumsum(covered, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for _, _, t in C.text_steps(column):
        starts, ends, at = t.word_spans()
        chars = ((t.raw & 0xC0) != 0x80) & ~C._SPACE[t.raw]
        parts["n_words"].append(np.diff(at))
        parts["word_chars"].append(t.per_text(chars, t.bounds))
        parts["n_symbols"].append(t.per_text(_SYMBOL[t.raw], t.bounds))
        raw, b = t.raw.tobytes(), t.bounds.tolist()
        parts["n_dup_lines"].append(np.array([_dup_lines(raw[x:y]) for x, y in zip(b, b[1:], strict=False)], np.int64))
        parts["n_repeat_words"].append(repeated_words(t.hashes(starts, ends), at))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the five counts of each row's text."""
    C.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = text_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[k], pa.int64()) for k in COUNTS)], names=["doc_id", "host", *COUNTS])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{k} long" for k in COUNTS))


def host_verdicts(judged: DataFrame, multiple: float = HOST_MULTIPLE, rates: tuple[float, float] = HOST_RATES) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_rejected from rows of (host, base_failed).

    The prior Beta(a, b) has the mean and, by the method of moments, the spread of the hosts' rates; where the rates
    spread no more than chance would, the prior weighs as much as an average host has documents.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    r = F.col("n_failed") / F.col("n_docs")
    m = F.col("m")
    prior = (
        hosts.agg(
            (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
            F.coalesce(F.var_samp(r), F.lit(0.0)).alias("v"),
            F.avg("n_docs").alias("size"),
            F.avg(F.lit(1.0) / F.col("n_docs")).alias("inv"),
        )
        .select("m", (F.col("v") - m * (1 - m) * F.col("inv")).alias("between"), "size")
        .select("m", F.when((F.col("between") > 0) & (m > 0) & (m < 1), F.greatest(m * (1 - m) / F.col("between") - 1, F.lit(1.0))).otherwise(F.col("size")).alias("strength"))
    )
    shrunk = (F.col("n_failed") + m * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    # one row of the prior beside each host
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > F.least(F.lit(rates[1]), F.greatest(F.lit(rates[0]), m * multiple))).alias("host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", multiple: float = HOST_MULTIPLE, rates: tuple[float, float] = HOST_RATES) -> DataFrame:
    """One row per row of docs: doc_id, host, the counts, base_failed, shrunk_rate, kept."""
    counted = document_counts(docs, id_col, text_col, host_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rows = C.cut(counted.withColumn("base_failed", failed))
    hosts = C.cut(host_verdicts(rows, multiple, rates))
    out = C.join_small(rows, hosts.select("host", "shrunk_rate", "host_rejected"), "host")
    return out.select("doc_id", "host", *COUNTS, "base_failed", "shrunk_rate", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", *COUNTS, "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
ln AS (SELECT doc_id, l, count(*) AS c
       FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dl AS (SELECT doc_id, sum(c - 1) AS n FROM ln GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p0 AS (SELECT sum(k) / sum(n) AS m, coalesce(var_samp(k / n), 0) AS v, avg(n) AS sz, avg(1 / n) AS inv FROM h),
p AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 0 AND m > 0 AND m < 1
                     THEN greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1) ELSE sz END AS s FROM p0),
bad AS (SELECT source FROM h, p WHERE (k + m * s) / (n + s) > least(0.5, greatest(0.2, 3 * m)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad))) AS kept
FROM f
"""

"""Packing by concatenating and cutting.

All token streams, each document's closed by an end token, are laid end to end and cut into windows of a fixed length,
so only the last window of the corpus can be short. Pass one tokenizes once, keeps the ids and sums them by partition;
prefix sums over the partition totals give every document its global offset; pass two, in SQL functions, cuts each document
at the window bounds. A document that crosses a bound gives one piece a window, the boundary record.

Edge cases: a null text packs as an empty one, as its end token alone. Repeated rows and ids are packed each. A text
longer than a window spreads over many. An empty table gives no pieces. Other columns are ignored, whatever their names.
The ids are those of the tokenizer file, without the special tokens that it would put around a text; a string within a
text that the file declares as an added token has that token's id.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: How byte-level BPE files split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts that Spark hands to Python at a time: its buffers, and a worker's, grow with them.
BATCH_ROWS = 512


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level BPE files: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.cache
def encoder(path: str):
    """text -> ids (numpy uint32) for a byte-level BPE file, .json or .tiktoken.

    The .json file's vocabulary numbers its merges in rank order, so the merges run in the much faster library on the
    same ids; tests hold the ids against the file's own library.
    """
    import tiktoken

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
            raise ValueError("added tokens that take in what stands around them are not supported")
        special = {x["content"]: x["id"] for x in added}
        back = _byte_of()
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    else:
        special = {}
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: bpe.encode_to_numpy(text, allowed_special="all")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """part, start (ids before the row in its part), doc_id, n_tokens, ids (little-endian unsigned 32 bit), end token included."""
    C.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path(name))
        end = np.array([end_id], "<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                ids = [encode(t or "").astype("<u4").tobytes() + end for t in b.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), b.column(0), pa.array(n), pa.array(ids, pa.binary())], names=["part", "start", "doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "part int, start long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset. The ids are the sequences' own."""
    with C.settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}):
        tokens = C.cut(tokenize(docs, id_col, text_col, path, name, end_id))
    # one row a partition of the first pass, so as many as it had tasks
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base = [(r.part, at) for r, at in zip(totals, accumulate((r.n for r in totals), initial=0), strict=False)]
    offsets = docs.sparkSession.createDataFrame(base, "part int, base long")
    first, n = F.col("first"), F.col("n_tokens")

    def piece(seq: Column) -> Column:
        """The ids of a document that fall into one window; the array of a document's pieces is as long as its ids."""
        lo, hi = F.greatest(first, seq * length), F.least(first + n, (seq + 1) * length)
        ids = F.substring("ids", (4 * (lo - first) + 1).cast("int"), (4 * (hi - lo)).cast("int"))
        return F.struct((lo - first).alias("start"), (hi - lo).alias("length"), ids.alias("ids"), seq.alias("sequence_id"), (lo - seq * length).alias("offset"))

    whole = tokens.join(F.broadcast(offsets), "part").select("doc_id", "n_tokens", "ids", (F.col("start") + F.col("base")).alias("first"))
    window = lambda at: F.call_function("div", at, F.lit(length).cast("long"))
    windows = F.sequence(window(first), window(first + n - 1))
    pieces = whole.select("doc_id", n.alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(C.table(spark, sf_dir, "documents")))

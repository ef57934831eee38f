"""What the training-data operators share: tables, cut lineage, joins under skew, shipped code."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small side of a join is broadcast up to so many rows and bytes; beyond, both sides are shuffled and the hot keys salted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row(df: DataFrame) -> Column:
    """All columns as one struct: nothing that is added beside it can clash with their names."""
    return F.struct(*[col(c) for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, the warehouse; a temporary folder only where all
    runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="melisma-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/melisma-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs no recomputation of what came before.

    by: a column of few values to lay the files out by, so that a filter on it reads only its files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/melisma/{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame | None) -> None:
    """Delete cut tables that nothing needs any more, and let Spark clean up the shuffles behind them."""
    spark = None
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if "=" in path.getName():
                path = path.getParent()
            if path.getParent().getName() == "melisma":
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if spark is not None:
        sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held; its cleaner works in the background."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Within, the session has these settings; what it had comes back."""
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def short_plans(spark: SparkSession, most: int = 20_000):
    """Within, descriptions of plans are cut to so many characters: a table among the literals would fill the driver."""
    return settings(spark, {"spark.sql.maxPlanStringLength": most})


def plan_bytes(df: DataFrame) -> int:
    """The size that the planner knows a table by: of a cut table and its columns, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS, salted: bool = True) -> DataFrame:
    """Join with a side that has one row a key: broadcast if its counted rows and its size allow it, else dealt out with
    salted keys (or plain ones, where no key of `big` can be hot).

    Null keys match nothing. `small` should be cheap to count (a cut table).
    """
    if plan_bytes(small) <= BROADCAST_BYTES and small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), key, how)
    if not salted:
        return big.join(small, key, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(spread, [key, "_salt"], how).drop("_salt")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_melisma_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="melisma-code-")
    path = f"{folder}/melisma.zip"
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("melisma", os.path.relpath(full, top)))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._melisma_shipped = True


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % F.lit(n)


#: The words of all contracts: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


# ---- vectorised work on batches of texts (numpy over the Arrow buffers) ----

#: Bytes of text that one vectorised step takes at a time (a longer text is a step of its own).
STEP_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n. Kept for a step's length; longer tables are made for one use."""
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS["up"], _POWERS["down"]
    size, made = max(n, STEP_BYTES + 2), {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        made[name] = p
    if n <= STEP_BYTES + 2:
        _POWERS.update(made)
    return made["up"], made["down"]


class Texts:
    """Some consecutive texts as one byte buffer. Null texts count as empty."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.raw, self.bounds = raw, bounds  # uint8; int64, one more than texts

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (one more than texts)."""
        space = _SPACE[self.raw]
        inner = np.flatnonzero(~space)
        if not len(inner):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.bounds), np.int64)
        opens = np.ones(len(inner), bool)
        opens[1:] = np.diff(inner) > 1
        # a word also opens where a text does: two texts stand in the buffer without a gap
        opens |= np.isin(inner, self.bounds, assume_unique=False) if len(self.bounds) > 2 else False
        starts = inner[opens]
        last = np.flatnonzero(opens)[1:] - 1
        ends = np.append(inner[last], inner[-1]) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, which follow one another, by differences of one running polynomial sum. A long
        text goes piece by piece: what is held besides grows with its longest span, not with its length."""
        out = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            zero = int(starts[a])
            b = max(a + 1, int(np.searchsorted(ends, zero + STEP_BYTES, "right")))
            x, y = starts[a:b] - zero, ends[a:b] - zero
            piece = self.raw[zero : int(ends[b - 1])]
            up, down = _powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_TABLE[piece] * up[: len(piece)], out=total[1:])
            out[a:b] = mix64((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64))
            a = b
        return out

    def per_text(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of values between the positions `at`."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]


def text_steps(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Texts]]:
    """Cut a batch's texts into steps of about STEP_BYTES: (first row, last row + 1, Texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = column.buffers()[2] if n else None
    raw = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(bounds, bounds[a] + STEP_BYTES, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, Texts(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        a = b

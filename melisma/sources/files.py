"""Scans of music folders (SRC-01 to 04, SRC-13) and of tables (SRC-05, 06, 11, 15)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import maps, strings

#: Extensions of audio files.
AUDIO = ("mp3", "m4a", "opus", "aac", "ogg", "flac")


def _children(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(name, path) of what stands directly in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [(s.getPath().getName(), s.getPath().toString()) for s in found]


def audio_files(spark: SparkSession, root: str, only: str | None = None, lo: str | None = None, hi: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """path, file_size, mtime of the audio files under a folder, by path (SRC-01, SRC-02).

    only, lo, hi narrow the first folder's name; after resumes behind a folder (FLT-20). Only folders that pass are
    listed at all, and the contents aren't read.
    """
    roots = [root]
    if only or lo is not None or hi is not None or after is not None:
        names = [(n.lower(), p) for n, p in _children(spark, root)]
        inside = lambda n: n.startswith(only.lower()) if only else (lo is None or n >= lo.lower()) and (hi is None or n <= hi.lower() + "\U0010ffff")
        roots = [p for n, p in names if inside(n) and (after is None or n > after.lower())]
        if not roots:
            return spark.createDataFrame([], "path string, file_size long, mtime timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    top = "/" + root.removeprefix("file:").lstrip("/") if root.startswith(("file:", "/")) else root
    rows = found.withColumn("path", strings.relative_path(plain("path"), top)).where(F.lower(strings.extension(F.col("path"))).isin(*AUDIO))
    rows = rows.orderBy("path")
    return rows if limit is None else rows.limit(limit)


def tag_map(files: DataFrame, entries: str = "entries") -> DataFrame:
    """With tags: upper-case keys to values, the first container's value first (SRC-03). entries: array of (key, value)."""
    return files.withColumn("tags", maps.upper_keys(F.col(entries)))


def track_meta(files: DataFrame) -> DataFrame:
    """The columns of a track from its tag map (SRC-04)."""
    m = F.col("tags")
    v = lambda *k: maps.first_value(m, *k)
    year = F.substring(v("YEAR", "DATE"), 1, 4).try_cast("int")
    cols = {
        "title": v("TITLE"), "artist": v("ARTIST"), "album_artist": v("ALBUMARTIST", "ALBUM_ARTIST", "ALBUM ARTIST"), "album": v("ALBUM"), "genre": v("GENRE"), "year": year,
        "track_number": strings.leading_number(v("TRACKNUMBER", "TRACK")), "disc_number": strings.leading_number(v("DISCNUMBER", "DISC")), "position": maps.value(m, "POSITION"), "metadata": maps.other_tags(m),
    }
    out = files.withColumns(cols)
    hash_ = strings.content_hash(*[F.col(c) for c in ("artist", "album_artist", "album", "title", "year", "track_number", "disc_number", "genre")])
    return out.withColumn("content_hash", hash_)


def by_key(table: DataFrame, **key) -> DataFrame:
    """Point lookup (SRC-05): one predicate that the scan can use."""
    out = table
    for c, v in key.items():
        out = out.where(F.col(c) == v)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n of all tables that have rows (SRC-15): one plan, one count a branch."""
    parts = [t.groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def byte_range(files: DataFrame, start: int, end: int, path: str = "path") -> DataFrame:
    """path and the bytes start to end, both included, of files (SRC-13). Only these bytes are read, by the executors; a
    file that ends before gives what it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        from pyarrow import fs

        for b in batches:
            parts = []
            for uri in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(quote(re.sub("^(?:file:)?/+", "file:///", uri), safe="/:@"))
                with store.open_input_file(name) as f:
                    f.seek(min(start, f.size()))
                    parts.append(f.read(max(0, end - start + 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], names=["path", "part"])

    return files.select(F.col(path).alias("path")).mapInArrow(run, "path string, part binary")

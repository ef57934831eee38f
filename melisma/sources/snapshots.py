"""Snapshots of tables (SNK-15, SNK-16, SRC-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dump(tables: dict[str, DataFrame], folder: str, stamp: str) -> str:
    """Write all tables under one stamp; returns its folder."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{stamp}/{name}")
    return f"{folder}/{stamp}"


def _children(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(path) if s.isDirectory()]


def newest(spark: SparkSession, folder: str) -> str | None:
    """The stamp written last."""
    return max(_children(spark, folder), default=(0, None))[1]


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest snapshot; none if there is none."""
    last = newest(spark, folder)
    return {} if last is None else {p.rsplit("/", 1)[1]: spark.read.parquet(p) for _, p in sorted(_children(spark, last))}


def report(folder: str, **parts: DataFrame) -> None:
    """A report's tables as JSON lines, a folder each (SNK-16)."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def append_errors(rejects: DataFrame, folder: str) -> None:
    """Append-only log of rejects (SNK-17)."""
    rejects.write.mode("append").json(folder)

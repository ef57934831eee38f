"""Change detection and the writes of an incremental load (CDC-*, SNK-*).

Spark tables have no keys or triggers, so every write is a function from old rows and new ones to the next snapshot.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.functions import dates, strings


def classify(scanned: DataFrame, known: DataFrame, key: str = "file_path") -> DataFrame:
    """scanned (key, file_size, mtime, content_hash) with action NEW, SKIP, TOUCH or UPDATE (CDC-01).

    Equal in size and within two seconds is unchanged; else an equal hash means that only the time is new. A missing
    known size or time equals nothing.
    """
    old = known.select(key, F.col("file_size").alias("_s"), F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"), F.lit(True).alias("_k"))
    near = F.coalesce((F.col("file_size") == F.col("_s")) & (dates.seconds_apart(F.col("mtime"), F.col("_m")) < 2), F.lit(False))
    action = F.when(F.col("_k").isNull(), "NEW").when(near, "SKIP").when(F.col("content_hash").eqNullSafe(F.col("_h")), "TOUCH").otherwise("UPDATE")
    return scanned.join(old, key, "left").withColumn("action", action).drop("_s", "_m", "_h", "_k")


def natural_id(*parts: Column) -> Column:
    """A stable id from a natural key."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those of wanted whose key is new, one a key (SNK-01, 03, 06, 07, 18)."""
    least = wanted.groupBy(*keys).agg(F.min(F.struct(*[c for c in wanted.columns if c not in keys])).alias("r")) if len(wanted.columns) > len(keys) else wanted.select(*keys).distinct()
    rows = least.select(*keys, "r.*") if "r" in least.columns else least
    return existing.unionByName(rows.join(existing, keys, "left_anti"), allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot of a table (SNK-02, 05, 08).

    Incoming values replace old ones, but for the columns in keep, whose old values stay, and those in fill, where the
    old value stays if the new one is null. Both sides have one row a key.
    """
    a, b = existing.alias("a"), incoming.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    has_old, has_new = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys or c in fill:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in incoming.columns else F.col(f"a.{c}")
        if c not in incoming.columns:
            return F.col(f"a.{c}")
        if c in keep:
            return F.when(has_old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        return F.when(has_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return a.join(b, on, "full").select(*[value(c).alias(c) for c in existing.columns])


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All rows of a parent that comes in are replaced (SNK-10)."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def bulk_rows(arrays: DataFrame, **columns: str) -> DataFrame:
    """Rows from parallel arrays (SNK-09, ARR-05): column=array name."""
    zipped = F.arrays_zip(*[F.col(a).alias(c) for c, a in columns.items()])
    return arrays.select(F.inline(zipped)).toDF(*columns)


def delete_cascade(parents: DataFrame, doomed: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents without the doomed, and each child table without the rows of doomed parents (SNK-11)."""
    out = {"": parents.join(doomed.select(key).distinct(), key, "left_anti")}
    for name, (rows, ref) in children.items():
        out[name] = rows.join(doomed.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
    return out


def deletion_queue(old: DataFrame, new: DataFrame, key: str, prefix: str, stem: str, url: str = "image_url") -> DataFrame:
    """object_key of what a deleted row had in store: only rows with an address (SNK-12)."""
    gone = old.join(new, key, "left_anti").where((F.col(url).isNotNull()) & (F.col(url) != ""))
    return gone.select(F.concat(F.lit(f"{prefix}/"), F.col(stem).cast("string"), F.lit(".jpg")).alias("object_key"))


def drain(queue: DataFrame, results: DataFrame, key: str = "object_key") -> DataFrame:
    """What stays in a queue: items that no backend has handled (SNK-13). results: key, ok."""
    done = results.groupBy(key).agg(F.bool_or("ok").alias("ok")).where("ok")
    return queue.join(done, key, "left_anti")


def emptied(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same schemas without rows (SNK-14)."""
    return {k: v.limit(0) for k, v in tables.items()}


def next_position(entries: DataFrame, parents: DataFrame, parent: str, position: str = "position") -> DataFrame:
    """For each parent the place after its last entry, 0 without any (AGG-10)."""
    top = entries.groupBy(parent).agg(F.max(position).alias("_p"))
    return parents.select(parent).join(top, parent, "left").select(parent, F.coalesce(F.col("_p") + 1, F.lit(0)).cast("long").alias("next_position"))


def update_totals(parents: DataFrame, children: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """Parents with new totals of their children; a parent without children keeps its old ones (JN-15, AGG-01, AGG-02)."""
    new = children.groupBy(key).agg(*[c.alias(f"_{n}") for n, c in totals.items()])
    return parents.join(new, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in totals else F.col(c) for c in parents.columns])


def rejects(rows: DataFrame, bad: Column, source: str, message: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects as source and message) (FLT-19, SNK-17)."""
    bad = F.coalesce(bad, F.lit(False))
    return rows.where(~bad), rows.where(bad).select(F.lit(source).alias("source"), message.alias("message"))


def run_summary(classified: DataFrame) -> DataFrame:
    """Counts of a run by action (AGG-23)."""
    return classified.groupBy("action").agg(F.count("*").alias("n"))


def checkpoint_row(cursor: str, done: int, spark) -> DataFrame:
    """The one row that a run resumes from (CDC-02)."""
    return spark.range(1).select(F.lit("main").alias("id"), F.lit(cursor).alias("cursor"), F.lit(done).cast("long").alias("done"))


class Checkpoint:
    """Where a run stands, kept in a folder that all machines see (CDC-02). Saves add a version; the newest one counts."""

    SCHEMA = "id string, cursor string, done long, version long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        """All versions; none where nothing was saved or all was cleared."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def save(self, state: DataFrame) -> None:
        """state: one row of cursor and done, written by the executors; no value passes through the driver."""
        last = self.rows().agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
        row = state.select(F.lit("main").alias("id"), F.col("cursor").cast("string").alias("cursor"), F.col("done").cast("long").alias("done"))
        row.crossJoin(F.broadcast(last)).select("id", "cursor", "done", (F.col("last") + 1).cast("long").alias("version")).write.mode("append").parquet(self.folder)

    def load(self) -> DataFrame:
        """id, cursor, done of the newest version, or no row."""
        newest = self.rows().groupBy("id").agg(F.max_by(F.struct("cursor", "done"), "version").alias("s"))
        return newest.select("id", "s.cursor", "s.done")

    def clear(self) -> None:
        """Forget all: an empty version replaces the folder."""
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.folder)


def create_playlists(existing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(playlists, rejects) after new ones by name: a slug that is taken, or wanted twice, is refused but for the first
    name in order (SNK-19). existing: slug, name; wanted: name."""
    named = wanted.select(strings.ascii_slug(F.col("name")).alias("slug"), "name")
    new = named.where("slug <> ''").groupBy("slug").agg(F.min("name").alias("name")).join(existing.select("slug"), "slug", "left_anti")
    refused = named.join(new, ["slug", "name"], "left_anti").select(F.lit("playlist").alias("source"), F.concat(F.lit("slug taken: "), "slug").alias("message"))
    return existing.select("slug", "name").unionByName(new), refused


def delete_playlists(playlists: DataFrame, entries: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(playlists, entries) without the doomed slugs (SNK-19)."""
    gone = doomed.select("slug").distinct()
    return playlists.join(gone, "slug", "left_anti"), entries.join(gone, "slug", "left_anti")


def add_entries(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Entries with new tracks behind each playlist's last position, in the order given; a track that is already there
    stays where it is (SNK-19). entries: slug, track_id, position; tracks: slug, track_id, n."""
    first = tracks.groupBy("slug", "track_id").agg(F.min("n").alias("n")).join(entries.select("slug", "track_id"), ["slug", "track_id"], "left_anti")
    top = entries.groupBy("slug").agg(F.max("position").alias("top"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("n", "track_id"))
    new = first.withColumn("place", place).join(top, "slug", "left")
    return entries.unionByName(new.select("slug", "track_id", (F.coalesce("top", F.lit(-1)) + F.col("place")).cast("long").alias("position")))


class Pace:
    """The wait between requests to an outside service (CDC-03): shorter after a success, twice as long when refused."""

    def __init__(self, least: float = 1.0, most: float = 10.0, start: float = 1.0):
        self.least, self.most, self.wait = least, most, start

    def success(self) -> float:
        self.wait = max(self.least, self.wait * 0.85)
        return self.wait

    def refused(self) -> float:
        self.wait = min(self.most, self.wait * 2)
        return self.wait

    @staticmethod
    def retry_after(attempt: int, attempts: int = 10, most: float = 60.0) -> float | None:
        """Seconds to wait before attempt + 1; None when there is none left."""
        return min(most, 2.0**attempt) if attempt < attempts else None

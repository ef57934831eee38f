"""Play events as a stream (STM-01, STM-06, STM-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.sources.folders import work_folder


def events(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Files of a folder that match a name, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def play_counts(plays: DataFrame, key: str) -> DataFrame:
    """key, plays, last_played: every event counts once, whatever its order of arrival."""
    return plays.groupBy(key).agg(F.count("*").alias("plays"), F.max("ts").alias("last_played"))


def play_totals(plays: DataFrame, kinds: tuple[str, ...] = ("track", "release", "artist")) -> DataFrame:
    """kind, id, plays, last_played of tracks, their releases and artists (STM-01): a play counts for each, in one pass.

    plays: ts and a column <kind>_id for each kind there is; null where there is none, as for a loose track's release.
    """
    of = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("long").alias("id"))
    each = plays.select("ts", F.explode(F.array(*[of(k) for k in kinds if f"{k}_id" in plays.columns])).alias("k")).select("k.kind", "k.id", "ts")
    return each.where("id is not null").groupBy("kind", "id").agg(F.count("*").alias("plays"), F.max("ts").alias("last_played"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return what it last wrote."""
    spark = stream.sparkSession
    at = work_folder(spark, "stream")
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")

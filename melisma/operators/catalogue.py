"""The pages of a catalogue over its tables: an artist's releases, search, favourites, home and timeline (QRY-*).

Tables and the columns used: artists (id, name, average_match_score), reference (id, artist_id, title, year, type,
status), local (id, artist_id, title, year, release_id, match_status, created_at, last_played_at), tracks (id, title,
local_release_id), track_artists (track_id, artist_id). Each function takes many artists or names at once where it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.operators import browse

_RELEASE = "artist_id", "id", "title", "year", "type", "status", "local_release_id"


def artist_releases(artists: DataFrame, reference: DataFrame, local: DataFrame, tracks: DataFrame, track_artists: DataFrame) -> DataFrame:
    """One list of releases an artist (QRY-01): artist_id, id, title, year, type, status, local_release_id.

    Reference releases come with the local release that stands for them: of those in which the artist has tracks the last
    by year and title (JN-08), else the first one linked. Then come local releases without a reference (Unmatched), and
    those whose reference is another artist's (Appears On), unless they stand for one already. artists: id.
    """
    who = artists.select(F.col("id").alias("artist_id")).distinct()
    refs = reference.join(who, "artist_id", "left_semi")
    links = track_artists.join(who, "artist_id", "left_semi").join(tracks.select(F.col("id").alias("track_id"), "local_release_id"), "track_id")
    links = links.where("local_release_id is not null").select("artist_id", F.col("local_release_id").alias("id")).distinct()
    mine = links.join(local.drop("artist_id"), "id")
    order = F.struct(F.col("year").isNull(), "year", "title", "id")
    own = mine.where("release_id is not null").groupBy("artist_id", F.col("release_id").alias("ref")).agg(F.max_by("id", order).alias("own"))
    linked = local.where("release_id is not null").groupBy(F.col("release_id").alias("ref")).agg(F.min("id").alias("linked"))
    listed = refs.withColumnRenamed("id", "ref").join(own, ["artist_id", "ref"], "left").join(linked, "ref", "left").withColumn("local_release_id", F.coalesce("own", "linked"))
    listed = listed.select("artist_id", F.col("ref").alias("id"), "title", "year", "type", "status", "local_release_id")
    left = mine.join(listed.select("artist_id", F.col("local_release_id").alias("id")).where("id is not null"), ["artist_id", "id"], "left_anti")
    others = left.where("release_id is not null").join(refs.select("artist_id", F.col("id").alias("release_id")), ["artist_id", "release_id"], "left_anti")
    rest = lambda df, kind: df.select("artist_id", "id", "title", "year", F.lit(kind).alias("type"), F.col("match_status").alias("status"), F.col("id").alias("local_release_id"))
    return listed.select(*_RELEASE).unionByName(rest(left.where("release_id is null"), "Unmatched")).unionByName(rest(others, "Appears On"))


def search(text: str, artists: DataFrame, local: DataFrame, reference: DataFrame, tracks: DataFrame, most: int = 5, shortest: int = 2) -> DataFrame:
    """kind, id, label: the first artists, releases and tracks whose name holds a text, case aside (QRY-02, FLT-23)."""
    if len(text.strip()) < shortest:
        return artists.limit(0).select(F.lit("").alias("kind"), "id", F.col("name").alias("label"))
    has = lambda c: browse.contains_text(F.col(c), text)
    out = lambda df, kind, label, *order: df.orderBy(*order).limit(most).select(F.lit(kind).alias("kind"), "id", F.coalesce(*label).alias("label"))
    titles = reference.select(F.col("id").alias("release_id"), F.col("title").alias("reference_title"))
    releases = local.join(titles, "release_id", "left").where(browse.nullsafe_any(has("title"), has("reference_title")))
    return (
        out(artists.where(has("name")), "artist", [F.col("name")], F.desc_nulls_first("average_match_score"), F.asc("name"), F.asc("id"))
        .unionByName(out(releases, "release", [F.nullif(F.col("title"), F.lit("")), F.col("reference_title"), F.lit("Unknown Release")], F.desc("created_at"), F.asc("id")))
        .unionByName(out(tracks.where(has("title")), "track", [F.col("title")], F.asc("title"), F.asc("id")))
    )


def favourites(releases: DataFrame, tracks: DataFrame, reference: DataFrame, local: DataFrame, all_tracks: DataFrame) -> DataFrame:
    """kind, id, title, shown_id, created_at of favourite releases and tracks (QRY-03); a release shows its first local one.

    releases: release_id, created_at; tracks: track_id, created_at. What no longer exists drops out.
    """
    first = local.where("release_id is not null").groupBy("release_id").agg(F.min("id").alias("local_id"))
    a = releases.join(reference.select(F.col("id").alias("release_id"), "title"), "release_id").join(first, "release_id", "left")
    b = tracks.join(all_tracks.select(F.col("id").alias("track_id"), "title"), "track_id")
    return a.select(F.lit("release").alias("kind"), F.col("release_id").alias("id"), "title", F.coalesce("local_id", "release_id").alias("shown_id"), "created_at").unionByName(
        b.select(F.lit("track").alias("kind"), F.col("track_id").alias("id"), "title", F.col("track_id").alias("shown_id"), "created_at")
    )


def home(local: DataFrame, playlists: DataFrame, favourite_releases: DataFrame, most: int = 12) -> DataFrame:
    """part, id, place: the shelves of the first page (QRY-04). playlists: id, name; favourite_releases: id, created_at."""

    def shelf(df: DataFrame, part: str, *order: Column) -> DataFrame:
        # a dozen rows: their places need no more than one task
        place = F.row_number().over(Window.orderBy(*order, F.asc("id")))
        return df.orderBy(*order, F.asc("id")).limit(most).select(F.lit(part).alias("part"), "id", place.cast("long").alias("place"))

    return (
        shelf(local, "latest", F.desc("created_at"))
        .unionByName(shelf(local.where("last_played_at is not null"), "played", F.desc("last_played_at")))
        .unionByName(shelf(playlists, "playlists", F.asc("name")))
        .unionByName(shelf(favourite_releases, "favourites", F.desc("created_at")))
    )


def timeline(local: DataFrame, artists: DataFrame, decade: int, number: int = 1, size: int = 48) -> DataFrame:
    """One page of a decade's releases with their artists' names, by year, title and id (AGG-05, SRT-05)."""
    rows = local.where(browse.in_period(F.col("year"), decade)).join(artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id")
    return browse.page(rows, [F.asc("year"), F.asc("title"), F.asc("id")], number, size).select("id", "title", "year", "artist")

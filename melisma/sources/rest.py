"""Bodies of a metadata service: pages, search hits, details, pictures (SRC-07 to 10, JSN-*).

The rows are bodies that were fetched and landed; parsing them is plain column work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH = "artists array<struct<id: string, name: string, score: int>>"
GROUPS = "`release-groups` array<struct<id: string, title: string, `primary-type`: string, `secondary-types`: array<string>, `first-release-date`: string>>, `release-group-count` int, `release-group-offset` int"
EDITIONS = "releases array<struct<id: string, title: string, date: string, media: array<struct<position: int, tracks: array<struct<id: string, title: string, position: int, length: bigint>>>>>>"
DETAIL = "id string, name string, relations array<struct<type: string, url: struct<resource: string>>>, genres array<struct<name: string, count: int>>, tags array<struct<name: string, count: int>>"


def pages(fetch: Callable[[int, int], tuple[list, int]], size: int = 100) -> Iterator[list]:
    """Items page by page until the total is reached or a page is empty (SRC-07). fetch(limit, offset) -> (items, total)."""
    offset = 0
    while True:
        items, total = fetch(size, offset)
        if not items:
            return
        yield items
        offset += len(items)
        if offset >= total:
            return


def parsed(bodies: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """With json: the body as a struct, null where it can't be read (JSN-02)."""
    return bodies.withColumn("json", F.from_json(body, schema))


def search_hits(bodies: DataFrame) -> DataFrame:
    """query, rank, id, name, score of search results (SRC-08)."""
    hits = parsed(bodies, SEARCH).select("query", F.posexplode("json.artists").alias("rank", "a"))
    return hits.select("query", "rank", "a.id", "a.name", "a.score")


def edition_tracks(bodies: DataFrame) -> DataFrame:
    """release_id, track_id, title, position, length of the first edition's tracks, all media in order (SRC-08)."""
    first = parsed(bodies, EDITIONS).select("release_id", F.get("json.releases", F.lit(0)).alias("e"))
    media = first.select("release_id", F.explode("e.media").alias("m"))
    tracks = media.select("release_id", F.col("m.position").alias("medium"), F.explode("m.tracks").alias("t"))
    return tracks.select("release_id", "medium", F.col("t.id").alias("track_id"), "t.title", "t.position", "t.length")


def picture_name(body: Column) -> Column:
    """The file name deep in an entity's claims (SRC-09): the entity's key is unknown beforehand."""
    entities = F.from_json(body, "entities map<string, string>")["entities"]
    return F.get_json_object(F.get(F.map_values(entities), F.lit(0)), "$.claims.P18[0].mainsnak.datavalue.value")


def thumbnail(body: Column) -> Column:
    """The first thumbnail among pages of unknown keys (SRC-10)."""
    found = F.from_json(body, "query struct<pages: map<string, struct<thumbnail: struct<source: string>>>>")["query"]["pages"]
    urls = F.filter(F.transform(F.map_values(found), lambda p: p["thumbnail"]["source"]), lambda u: u.isNotNull())
    return F.get(urls, F.lit(0))


def messages(raw: DataFrame, schema: str, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed messages, rejects) of JSON texts (SRC-14); a body that isn't JSON of the schema is a reject."""
    both = raw.withColumn("m", F.from_json(body, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("m").isNull() | F.col("m._bad").isNotNull()
    return both.where(~bad).select("m.*").drop("_bad"), both.where(bad).select(F.lit("message").alias("source"), F.col(body).alias("message"))

"""Sources, sinks and rules that the other modules only use in passing, each as a query of its own."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from melisma.functions import dates, maps, strings
from melisma.operators import browse, changes, explore, matching, quality
from melisma.plans.domain import _E, _S, _files, _picked, _tracks
from melisma.plans.registry import query, table
from melisma.plans.streams import _messages
from melisma.sources import files, rest, snapshots
from melisma.sources.folders import work_folder
from melisma.streaming import plays, sessions


def _library(spark, d) -> str:
    """A folder of small files, one a nation under its region, some of them audio by name."""
    top = work_folder(spark)
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp3", "FLAC", "txt", "ogg", "jpg")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    named = rows.select(F.concat(F.lit(f"{top}/"), "r_name", F.lit("/CD "), (F.col("n_nationkey") % 2).cast("string"), F.lit("/"), "n_name", F.lit("."), ext).alias("path"), F.concat(F.lit("tag:"), "n_name").cast("binary").alias("body"))

    def write(batches):
        from urllib.parse import quote

        from pyarrow import fs

        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(quote(re.sub("^(?:file:)?/+", "file:///", path), safe="/:@"))
                store.create_dir(name.rsplit("/", 1)[0])
                with store.open_output_stream(name) as f:
                    f.write(body)
            yield b.select(["path"])

    named.mapInArrow(write, "path string").count()
    return top


_LIBRARY = "(SELECT r_name AS folder, r_name || '/CD ' || n_nationkey % 2 || '/' || n_name || '.' || ['mp3', 'FLAC', 'txt', 'ogg', 'jpg'][n_nationkey % 5 + 1] AS path, n_nationkey % 5 AS k, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT path, strlen(n_name) + 4 AS file_size FROM {_LIBRARY} WHERE k IN (0, 1, 3)")
def src01_scan(spark, d):
    return files.audio_files(spark, _library(spark, d)).select("path", "file_size")


@query(f"SELECT path, row_number() OVER (ORDER BY path) AS place FROM {_LIBRARY} WHERE k IN (0, 1, 3) AND lower(folder) >= 'am' AND lower(folder) <= 'eur' || chr(1114111) AND lower(folder) > 'america'")
def src02_sorted_scan(spark, d):
    found = files.audio_files(spark, _library(spark, d), lo="Am", hi="EUR", after="america")
    return browse.running(found, [F.asc("path")]).select("path", F.col("_place").alias("place"))


@query(f"SELECT path, substr('tag:' || n_name, 3, 4) AS part FROM {_LIBRARY}")
def src13_byte_range(spark, d):
    top = _library(spark, d)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).select("path")
    part = files.byte_range(found, 2, 5)
    return part.select(F.regexp_extract("path", "([^/]+/[^/]+/[^/]+)$", 1).alias("path"), F.decode("part", "utf-8").alias("part"))


def _entries(spark, d):
    """Documents as tag containers: repeated keys in mixed case."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    return table(spark, d, "documents").select("doc_id", F.array(pair("title", F.col("source")), pair("TITLE", F.col("lang")), pair("Track", F.concat("doc_id", F.lit("/99"))), pair("year", F.lit(1990) + F.col("doc_id") % 30), pair("artist", F.lit("x")), pair("mood_sad", F.col("n_chars")), pair("GENRE", F.lit(" "))).alias("entries"))


@query("SELECT doc_id, source AS title, 7 - 1 AS keys FROM documents")
def src03_tag_map(spark, d):
    m = files.tag_map(_entries(spark, d))
    return m.select("doc_id", maps.value(F.col("tags"), "TITLE").alias("title"), F.size("tags").alias("keys"))


@query("SELECT doc_id, source AS title, doc_id::INTEGER AS track_number, (1990 + doc_id % 30)::INTEGER AS year, n_chars::VARCHAR AS mood, md5('x|||' || lower(source) || '|' || (1990 + doc_id % 30) || '|' || doc_id || '|0|') AS content_hash FROM documents")
def src04_track_meta(spark, d):
    m = files.track_meta(files.tag_map(_entries(spark, d)))
    return m.select("doc_id", "title", "track_number", "year", F.col("metadata")["MOOD_SAD"].alias("mood"), "content_hash")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def src07_pages(spark, d):
    """The nations behind a paged service: each page is one request with limit and offset."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    total = rows.count()
    fetch = lambda n, o: (rows.orderBy("n_nationkey").offset(o).limit(n).collect(), total)
    return spark.createDataFrame([tuple(r) for page in rest.pages(fetch, 10) for r in page], rows.schema).toDF("id", "name")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'u' || event_id END IS NULL AS none, coalesce(CASE WHEN event_id % 4 <> 0 THEN 'u' || event_id END, '') AS thumbnail FROM events")
def src10_thumbnail(spark, d):
    none, some = F.lit('{"query":{"pages":{"7":{}}}}'), F.format_string('{"query":{"pages":{"%d":{"thumbnail":{"source":"u%d"}}}}}', "event_id", "event_id")
    url = rest.thumbnail(F.when(F.col("event_id") % 4 == 0, none).otherwise(some))
    return table(spark, d, "events").select("event_id", url.isNull().alias("none"), F.coalesce(url, F.lit("")).alias("thumbnail"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src12_restore(spark, d):
    top = work_folder(spark)
    snapshots.dump({"nation": table(spark, d, "nation")}, top, "20240101_000000")
    return snapshots.restore(spark, top)["nation"]


@query("SELECT 'region' AS part, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def snk15_dump(spark, d):
    at = snapshots.dump({t: table(spark, d, t) for t in ("region", "nation")}, work_folder(spark), "20240101_000000")
    n = lambda t: spark.read.parquet(f"{at}/{t}").groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("part"), "n")
    return n("region").unionByName(n("nation"))


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def snk16_report(spark, d):
    top = work_folder(spark)
    snapshots.report(top, brands=table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")))
    return spark.read.schema("brand string, n long").json(f"{top}/brands")


@query("SELECT 'index' AS source, 'no tracks: ' || o_orderkey AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'sync', 'failed: ' || s_suppkey FROM supplier WHERE s_acctbal < 0")
def snk17_error_log(spark, d):
    top, o = work_folder(spark), table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    bare = o.join(table(spark, d, "lineitem"), "l_orderkey", "left_anti")
    snapshots.append_errors(bare.select(F.lit("index").alias("source"), F.concat(F.lit("no tracks: "), F.col("l_orderkey").cast("string")).alias("message")), top)
    bad = changes.rejects(table(spark, d, "supplier"), F.col("s_acctbal") < 0, "sync", F.concat(F.lit("failed: "), F.col("s_suppkey").cast("string")))[1]
    snapshots.append_errors(bad, top)
    return spark.read.schema("source string, message string").json(top)


@query("SELECT c_custkey AS id, 'artist' AS kind FROM customer UNION ALL SELECT o_orderkey, 'release' FROM orders UNION ALL SELECT p_partkey, 'reference' FROM part")
def set01_union_all(spark, d):
    of = lambda t, c, k: table(spark, d, t).select(F.col(c).alias("id"), F.lit(k).alias("kind"))
    return of("customer", "c_custkey", "artist").unionByName(of("orders", "o_orderkey", "release")).unionByName(of("part", "p_partkey", "reference"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN p_name ELSE p_name || '+' || p_type END AS main, p_brand AS featured FROM part")
def str05_artist_tags(spark, d):
    s = matching.split_artists(F.concat("p_name", F.lit(" / "), "p_type", F.lit(" (feat. "), "p_brand", F.lit(")")))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", F.array_join("s.main", "+").alias("main"), F.array_join("s.featured", "+").alias("featured"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'audio/flac' WHEN 'click' THEN 'audio/ogg' ELSE 'audio/mpeg' END AS mime FROM events")
def str16_mime(spark, d):
    ext = F.when(F.col("event_type") == "view", "a/b.FLAC").when(F.col("event_type") == "click", "b.ogg").otherwise("c.xyz")
    return table(spark, d, "events").select("event_id", strings.mime_type(ext).alias("mime"))


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 DAYS AS stale FROM orders")
def dt07_stale(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.stale(F.col("o_orderdate"), F.lit("1999-01-01").cast("timestamp")).alias("stale"))


@query("SELECT doc_id, source AS first FROM documents")
def map02_priority(spark, d):
    m = files.tag_map(_entries(spark, d))
    return m.select("doc_id", maps.first_value(F.col("tags"), "GENRE", "ALBUM", "TITLE").alias("first"))


@query("SELECT doc_id, doc_id % 3 = 0 AS genre, doc_id % 2 = 0 AS album FROM documents")
def map03_has_key(spark, d):
    k = F.col("doc_id")
    pair = lambda name, test: F.struct(F.when(test, name).otherwise("other").alias("key"), F.lit(" ").alias("value"))
    m = files.tag_map(table(spark, d, "documents").select("doc_id", F.array(pair("Genre", k % 3 == 0), pair("ALBUM", k % 2 == 0)).alias("entries")))
    return m.select("doc_id", maps.has_key(F.col("tags"), "genre").alias("genre"), maps.has_key(F.col("tags"), "album").alias("album"))


@query("SELECT doc_id, 'LANG_' || coalesce(upper(lang), '') || CASE WHEN n_chars > 500 THEN ',MOOD_SAD' ELSE '' END AS keys FROM documents")
def map05_other_tags(spark, d):
    pair = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("value"))
    own = F.array(pair(F.lit("title"), F.col("source")), pair(F.lit("mood_sad"), F.when(F.col("n_chars") > 500, F.col("n_chars"))), pair(F.concat(F.lit("lang_"), F.coalesce("lang", F.lit(""))), F.lit("1")), pair(F.lit("blank"), F.lit(" ")))
    m = files.tag_map(table(spark, d, "documents").select("doc_id", own.alias("entries")))
    return m.select("doc_id", F.array_join(F.array_sort(F.map_keys(maps.other_tags(F.col("tags")))), ",").alias("keys"))


@query("SELECT doc_id, n_chars AS mood, true AS present FROM documents")
def map06_lookup(spark, d):
    m = files.tag_map(_entries(spark, d))
    v = maps.value(F.col("tags"), "MOOD_SAD")
    return m.select("doc_id", v.cast("long").alias("mood"), v.isNotNull().alias("present"))


@query("""SELECT count(*) FILTER (doc_id % 2 <> 0 OR doc_id % 3 = 0 OR doc_id % 5 IN (0, 1, 4)) AS critical, count(*) AS mb, count(*) AS any_issue FROM documents""")
def dq02_categories(spark, d):
    c = quality.categories(quality.rules(_files(spark, d)))
    return c.agg(F.count_if("has_critical").alias("critical"), F.count_if("has_mb").alias("mb"), F.count_if("has_issue").alias("any_issue"))


@query(f"""WITH t AS (SELECT p_partkey AS n, {_E}::DOUBLE AS e FROM part),
a AS (SELECT *, CASE WHEN e IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(e - 200.0 / 9) / 60) END AS g, CASE WHEN e IS NULL THEN 0.5 ELSE 0.75 END AS c, 60 + n % 120 AS b FROM t)
SELECT n::VARCHAR AS id, round(CASE WHEN n % 3 = 0 THEN 0.5 * CASE WHEN b BETWEEN 70 AND 100 THEN 1 WHEN greatest(70 - b, b - 100) <= 15 THEN 0.5 ELSE greatest(0, 1 - greatest(70 - b, b - 100) / 50.0) END
 + 0.5 * ((1 - 0.85) + (1 - abs(n % 100 - 30) / 100.0) + 1 + (1 - 0.05)) / 4 ELSE g * c END, 6) AS score FROM a""")
def exp03_energy(spark, d):
    t = _tracks(spark, d)
    return t.select("id", F.round(explore.energy_score(F.col("metadata"), explore.genre_value(F.col("genre"), explore.GENRE_ENERGY), 2), 6).alias("score"))


@query(f"""SELECT n::VARCHAR AS id, round(CASE WHEN n % 3 = 0 THEN 1 - (abs(n % 90 - 80) / 100.0 + abs(40 - 10) / 100.0) / 2 WHEN s IS NULL THEN 0.25 ELSE greatest(0, 1 - abs(s - 100.0 / 9) / 60) * 0.75 END, 6) AS score
FROM (SELECT p_partkey AS n, {_S}::DOUBLE AS s FROM part)""")
def exp06_sound(spark, d):
    t = _tracks(spark, d)
    return t.select("id", F.round(explore.sound_score(F.col("metadata"), explore.genre_value(F.col("genre"), explore.GENRE_SOUND), 1), 6).alias("score"))


@query("SELECT * FROM (VALUES ('energy places', 10), ('era places', 10), ('sound places', 10), ('genre energy', 69), ('genre sound', 55)) AS t(config, n)")
def exp07_configs(spark, d):
    sizes = (("energy places", explore.ENERGY), ("era places", explore.ERA), ("sound places", explore.SOUND), ("genre energy", explore.GENRE_ENERGY), ("genre sound", explore.GENRE_SOUND))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("config"), F.lit(len(v)).alias("n")) for k, v in sizes])))


@query("SELECT step, wait::DOUBLE AS wait FROM (VALUES (1, 2.0), (2, 4.0), (3, 8.0), (4, 10.0), (5, 8.5), (6, 7.225)) AS t(step, wait)")
def cdc03_pace(spark, d):
    p = changes.Pace()
    waits = [p.refused(), p.refused(), p.refused(), p.refused(), p.success(), p.success()]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(round(w, 6)).alias("wait")) for i, w in enumerate(waits)])))


@query("SELECT 's' || conv_id AS session_id, count(*) FILTER (turn = 0) > 0 AS active FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY 1")
def stm02_create(spark, d):
    return sessions.status(sessions.replay(_messages(spark, d))).select("session_id", "active")


@query("SELECT DISTINCT 's' || conv_id AS session_id, false AS active, 0 AS listeners FROM conversations")
def stm05_end(spark, d):
    m = _messages(spark, d)
    ends = m.groupBy("session_id").agg((F.max("seq") + 1).alias("seq")).select("session_id", "seq", F.lit("host").alias("peer_id"), F.lit("endSession").alias("type"), F.lit(None).cast("string").alias("track"), F.lit(None).cast("double").alias("position"))
    return sessions.status(sessions.replay(m.unionByName(ends))).select("session_id", "active", "listeners")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def stm07_broadcast(spark, d):
    stream = plays.events(spark, d, "events.parquet", table(spark, d, "events").schema)
    return plays.drained(stream.where("event_type = 'view'").select("event_id", "user_id"), "append")


@query(f"""WITH a AS (SELECT 0 AS place, id FROM {_picked(0.1, "''")}), b AS (SELECT 1 AS place, id FROM {_picked(0.5, "SELECT id FROM a")}),
c AS (SELECT 2 AS place, id FROM {_picked(0.9, "SELECT id FROM a UNION ALL SELECT id FROM b")}) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def stm11_auto_advance(spark, d):
    """Three draws in a row, each without what was drawn before."""
    tracks, seen = _tracks(spark, d), []
    for u in (0.1, 0.5, 0.9):
        seen += [r.id for r in explore.pick(tracks, 5, 3, 4, 6, u, exclude=seen, seed=1).collect()]
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in seen])).alias("place", "id"))


@query("SELECT * FROM (VALUES (0, 'release'), (1, 'artist'), (2, 'catalogue'), (3, 'off')) AS t(place, mode)")
def stm12_modes(spark, d):
    mode, out = "off", []
    for _ in range(4):
        mode = sessions.next_mode(mode)
        out.append(F.lit(mode))
    return spark.range(1).select(F.posexplode(F.array(*out)).alias("place", "mode"))

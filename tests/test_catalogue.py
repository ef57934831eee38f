"""The pages of a catalogue on a hand-made one."""

import datetime as dt

from melisma.operators import catalogue as K

T0 = dt.datetime(2024, 1, 1)


def tables(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "artists": mk([("a", "Björk", 0.9), ("b", "The Beatles", None), ("c", "beat", 0.5)], "id string, name string, average_match_score double"),
        "reference": mk([("r1", "a", "Debut", 1993, "Album", "COMPLETE"), ("r2", "a", "Post", 1995, "Album", "MISSING"), ("r3", "b", "Help!", 1965, "Album", "COMPLETE")], "id string, artist_id string, title string, year int, type string, status string"),
        "local": mk(
            [("l1", "a", "Debut", 1993, "r1", "COMPLETE", day(1), day(9)), ("l2", "a", "Debut (live)", 1994, "r1", "EXTRA_TRACKS", day(2), None), ("l3", "a", "Demos", None, None, None, day(3), None), ("l4", "b", "Help!", 1965, "r3", "COMPLETE", day(4), day(5)), ("l5", "a", None, 1999, "r2", "MISSING", day(5), None), ("l6", "b", "Guests", 1990, None, None, day(6), None)],
            "id string, artist_id string, title string, year int, release_id string, match_status string, created_at timestamp, last_played_at timestamp",
        ),
        "tracks": mk([("t1", "Human", "l1"), ("t2", "Human", "l2"), ("t3", "Sketch", "l3"), ("t4", "Help!", "l4"), ("t5", "Loose", None)], "id string, title string, local_release_id string"),
        "track_artists": mk([("t1", "a"), ("t2", "a"), ("t3", "a"), ("t4", "b"), ("t4", "a"), ("t5", "a")], "track_id string, artist_id string"),
    }


def test_artist_releases(spark):
    t = tables(spark)
    got = {(r.artist_id, r.id, r.type, r.local_release_id) for r in K.artist_releases(t["artists"], t["reference"], t["local"], t["tracks"], t["track_artists"]).collect()}
    assert got == {
        ("a", "r1", "Album", "l2"),  # of two local ones the last by year
        ("a", "r2", "Album", "l5"),  # no track of the artist's: the linked one
        ("a", "l3", "Unmatched", "l3"),
        ("a", "l4", "Appears On", "l4"),
        ("b", "r3", "Album", "l4"),
    }


def test_search(spark):
    t = tables(spark)
    find = lambda q: [(r.kind, r.id, r.label) for r in K.search(q, t["artists"], t["local"], t["reference"], t["tracks"]).collect()]
    assert find("BEAT") == [("artist", "b", "The Beatles"), ("artist", "c", "beat")]
    assert find("post") == [("release", "l5", "Post")] and find("p") == []
    assert find("hum") == [("track", "t1", "Human"), ("track", "t2", "Human")]


def test_favourites_home_and_timeline(spark):
    t = tables(spark)
    liked = spark.createDataFrame([("r1", T0), ("gone", T0), ("r2", T0)], "release_id string, created_at timestamp")
    songs = spark.createDataFrame([("t4", T0)], "track_id string, created_at timestamp")
    got = {(r.kind, r.id, r.shown_id) for r in K.favourites(liked, songs, t["reference"], t["local"], t["tracks"]).collect()}
    assert got == {("release", "r1", "l1"), ("release", "r2", "l5"), ("track", "t4", "t4")}
    lists = spark.createDataFrame([("p1", "B"), ("p2", "A")], "id string, name string")
    page = K.home(t["local"], lists, liked.withColumnRenamed("release_id", "id"), most=2)
    rows = {(r.part, r.place): r.id for r in page.collect()}
    assert rows[("latest", 1)] == "l6" and rows[("latest", 2)] == "l5" and rows[("played", 1)] == "l1" and rows[("played", 2)] == "l4"
    assert rows[("playlists", 1)] == "p2" and len(rows) == 8
    assert [r.id for r in K.timeline(t["local"], t["artists"], 1990).collect()] == ["l6", "l1", "l2", "l5"]

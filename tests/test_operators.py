"""Matching, rules, changes, sources and streams on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from melisma.operators import browse, changes, explore, matching, quality
from melisma.sources import files, rest, snapshots
from melisma.streaming import plays, sessions

T0 = dt.datetime(2024, 1, 1)


def test_match_status(spark):
    ref = spark.createDataFrame([(1, 1, "One", ["A", "B"]), (2, 1, "Two", ["A", "B"]), (3, 1, "Three", ["A", "B"]), (4, 1, "Four", ["A"]), (5, 1, "Five", [])], "ref_id int, artist_id int, title string, tracks array<string>")
    local = spark.createDataFrame([(10, 1, "one", ["a", "B!"]), (20, 1, "TWO", ["A", "B", "C"]), (30, 1, "Three", ["A"]), (31, 1, "three", ["A", "B"]), (50, 1, "Five", ["A"])], "local_id int, artist_id int, title string, tracks array<string>")
    got = {r.ref_id: (r.status, r.missing, r.extra, r.score) for r in matching.match_status(ref, local).collect()}
    assert got == {1: ("COMPLETE", 0, 0, 1.0), 2: ("EXTRA_TRACKS", 0, 1, 1.0), 3: ("INCOMPLETE", 1, 0, 0.5), 4: ("MISSING", 1, 0, 0.0), 5: ("EXTRA_TRACKS", 0, 1, 1.0)}


def test_classifier(spark):
    rows = [("a", 5, T0, "h"), ("b", 5, T0, "h"), ("c", 6, T0, "x"), ("d", 1, T0, "h"), ("e", 5, T0, "h")]
    known = [("a", 5, T0 + dt.timedelta(seconds=1), "z"), ("b", 5, T0 + dt.timedelta(seconds=2), "h"), ("c", 5, T0, "h"), ("e", None, T0, "h")]
    schema = "file_path string, file_size long, mtime timestamp, content_hash string"
    got = {r.file_path: r.action for r in changes.classify(spark.createDataFrame(rows, schema), spark.createDataFrame(known, schema)).collect()}
    assert got == {"a": "SKIP", "b": "TOUCH", "c": "UPDATE", "d": "NEW", "e": "TOUCH"}


def test_routing(spark):
    rows = [("Air/One/CD1/track01.mp3", True, True, True, False), ("Air/One/CD1/one.mp3", True, True, True, True), ("Air/One/bad.mp3", False, False, False, False), ("Air/x.mp3", True, False, True, False), ("Air/ok.mp3", True, False, False, False)]
    df = spark.createDataFrame(rows, "path string, readable boolean, has_issue boolean, had_issue boolean, lone boolean")
    assert {r.path.split("/")[-1]: r.destination for r in quality.route(df).collect()} == {"track01.mp3": "quarantine", "one.mp3": "needs-review", "bad.mp3": "unreadable", "x.mp3": "autofixed"}


def test_rules_and_pages(spark):
    tags = [{"ARTIST": "a", "TITLE": " ", "YEAR": "abc", "MOOD_X": "1"}, {}]
    df = spark.createDataFrame([(str(i), t, False) for i, t in enumerate(tags)], "path string, tags map<string,string>, has_art boolean")
    one, two = quality.categories(quality.rules(df)).orderBy("path").collect()
    assert (one.missing_artist, one.missing_title, one.blank_title, one.invalid_year, one.missing_mood) == (False, True, True, "abc", False)
    assert two.missing_year and not two.blank_year and two.has_critical and two.has_issue
    pages = quality.report_pages(spark.createDataFrame([(f"a{i:02}",) for i in range(41)], "artist string")).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in pages] == [20, 20, 1]


def test_pick(spark):
    rows = [(str(i), "Rock", 1990 + i % 10, i % 5, {"IntegerBpm": "x" if i % 2 else "100"}) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, genre string, year int, play_count long, metadata map<string,string>")
    scores = [r.score for r in explore.scored(df, 5, 3, 4, 5).collect()]
    assert all(0 <= s <= 1 for s in scores)
    best = sorted(scores, reverse=True)[:20]
    for u in (0.0, 0.5, 0.999):
        assert explore.pick(df, 5, 3, 4, 5, u).collect()[0].score >= best[-1]
    assert explore.pick(df.limit(0), 5, 3, 4, 5, 0.5).count() == 0
    assert {r.id for r in explore.candidates(df, 3, 9, ["0"]).collect()} == {str(i) for i in range(5, 60, 5)}


def test_pace():
    p = changes.Pace()
    assert p.refused() == 2 and p.refused() == 4 and p.success() == pytest.approx(3.4)
    for _ in range(9):
        p.refused()
    assert p.wait == 10 and changes.Pace.retry_after(10) is None and changes.Pace.retry_after(9) == 60


def test_audio_files(spark, tmp_path):
    for name in ("Air/One/a.mp3", "air/b.FLAC", "Beck/c.ogg", "Beck/cover.jpg", "Zed/d.opus"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    scan = lambda **k: [r.path for r in files.audio_files(spark, str(tmp_path), **k).collect()]
    assert scan() == ["Air/One/a.mp3", "Beck/c.ogg", "Zed/d.opus", "air/b.FLAC"]
    assert scan(lo="b", hi="b") == ["Beck/c.ogg"] and scan(after="beck") == ["Zed/d.opus"] and scan(limit=1) == ["Air/One/a.mp3"]
    body = spark.read.format("binaryFile").load(str(tmp_path / "Beck" / "c.ogg"))
    assert bytes(files.byte_range(body, 2, 4).first().part) == b"xxx" and bytes(files.byte_range(body, 8, 40).first().part) == b"xx" and files.byte_range(body, 40, 41).first().part == b""
    assert scan(only="nothing") == []
    (tmp_path / "Locked").mkdir()
    (tmp_path / "Locked").chmod(0)  # a folder that is left out isn't listed
    assert scan(only="be") == ["Beck/c.ogg"]
    (tmp_path / "Locked").chmod(0o755)


def test_track_meta(spark):
    pair = [("title", "T"), ("TITLE", "second"), ("track", "3/12"), ("YEAR", "1999-01-01"), ("mood_sad", "5"), ("artist", "A/B")]
    df = spark.createDataFrame([(pair,)], "entries array<struct<key:string,value:string>>")
    r = files.track_meta(files.tag_map(df)).first()
    assert (r.title, r.track_number, r.year, r.metadata, r.artist) == ("T", 3, 1999, {"MOOD_SAD": "5"}, "A/B")


def test_rest(spark):
    store = list(range(250))
    got = [x for page in rest.pages(lambda n, o: (store[o : o + n], len(store)), 100) for x in page]
    assert got == store and list(rest.pages(lambda n, o: ([], 10))) == []
    body = json.dumps({"releases": [{"id": "e1", "media": [{"position": 1, "tracks": [{"id": "t1", "title": "x", "position": 1, "length": 5}]}, {"position": 2, "tracks": [{"id": "t2", "title": "y", "position": 1, "length": None}]}]}, {"id": "e2"}]})
    tracks = rest.edition_tracks(spark.createDataFrame([("r", body), ("s", "not json")], "release_id string, body string")).collect()
    assert [(t.release_id, t.medium, t.track_id, t.length) for t in tracks] == [("r", 1, "t1", 5), ("r", 2, "t2", None)]
    good, bad = rest.messages(spark.createDataFrame([('{"type": "join"}',), ("{oops",)], "value string"), "type string")
    assert [r.type for r in good.collect()] == ["join"] and [r.message for r in bad.collect()] == ["{oops"]


def test_snapshots(spark, tmp_path):
    df = spark.range(3)
    snapshots.dump({"t": df}, str(tmp_path), "20240101_000000")
    snapshots.dump({"t": spark.range(5)}, str(tmp_path), "20240102_000000")
    assert snapshots.restore(spark, str(tmp_path))["t"].count() == 5
    (tmp_path / "none").mkdir()
    assert snapshots.restore(spark, str(tmp_path / "none")) == {}


def test_play_stream_equals_batch(spark, tmp_path):
    late = [("t1", T0 + dt.timedelta(hours=2)), ("t2", T0)], [("t1", T0), ("t1", T0 + dt.timedelta(hours=1))]
    for i, rows in enumerate(late):
        spark.createDataFrame(rows, "track_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 2
    df = spark.read.parquet(str(tmp_path / "in"))
    stream = plays.events(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    got = plays.drained(plays.play_counts(stream, "track_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plays.play_counts(df, "track_id").collect())) == [("t1", 3, T0 + dt.timedelta(hours=2)), ("t2", 1, T0)]


PARTY = [("create", "h", None, None), ("join", "p1", None, None), ("join", "p2", None, None), ("nowPlaying", "h", "song", 0.0), ("position", "h", None, 9.0), ("pause", "h", None, 9.5), ("leave", "p1", None, None), ("resume", "h", None, None), ("create", "h2", None, None), ("endSession", "h2", None, None), ("join", "p3", None, None)]


def test_session_states(spark, tmp_path):
    rows = [("s", i, *m) for i, m in enumerate(PARTY)]
    schema = "session_id string, seq long, type string, peer_id string, track string, position double"
    df = spark.createDataFrame(rows, schema)
    got = [(r.active, r.track, r.playing, r.position, r.listeners) for r in sessions.replay(df).orderBy("seq").collect()]
    assert got[2] == (True, None, False, 0.0, 2) and got[3] == (True, "song", True, 0.0, 2) and got[5] == (True, "song", False, 9.5, 2)
    assert got[6][4] == 1 and got[7][2] and got[8] == (True, None, False, 0.0, 0) and not got[9][0] and got[10] == got[9]
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = plays.drained(sessions.track_state(stream), "append")
    assert [(r.active, r.track, r.playing, r.position, r.listeners) for r in out.orderBy("seq").collect()] == got
    good, bad = sessions.dispatched(spark.createDataFrame([("join",), ("dance",), (None,)], "type string"))
    assert good.count() == 1 and sorted(r.message for r in bad.collect()) == ["unknown type: dance", "unknown type: null"]
    assert sessions.next_mode("catalogue") == "off"


def test_sessions_without_a_row_loop(spark):
    """The windows against the message-by-message rules, over random messages."""
    import random

    rng = random.Random(4)
    rows = [(f"s{i % 7}", i, rng.choice(["create", "join", "join", "leave", "close", "nowPlaying", "position", "pause", "resume", "endSession", "produce"]), rng.choice(["h", "p1", "p2", "p3", None]), rng.choice(["a", "b", None]), rng.choice([None, 1.5, 9.0])) for i in range(700)]
    df = spark.createDataFrame(rows, "session_id string, seq long, type string, peer_id string, track string, position double")
    want = {}
    for key in {r[0] for r in rows}:
        s = sessions.Session()
        for _, i, kind, peer, track, position in (r for r in rows if r[0] == key):
            s = sessions.step(s, kind, peer, track, position)
            want[i] = (s.active, s.track, s.playing, float(s.position), len(s.listeners))
    assert {r.seq: (r.active, r.track, r.playing, r.position, r.listeners) for r in sessions.replay(df).collect()} == want


def test_ranks_without_one_task(spark):
    rows = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(300)], "id long, w double")
    got = [(r._place, r._n, r.id, r._run, r._whole) for r in browse.running(rows, [F.desc("w"), F.asc("id")], "w").orderBy("_place").collect()]
    best = sorted(((i, float((i * 37) % 101)) for i in range(300)), key=lambda x: (-x[1], x[0]))
    total = 0.0
    for k, (i, w) in enumerate(best):
        total += w
        assert got[k][:3] == (k + 1, 300, i) and got[k][3] == pytest.approx(total)
    assert [r.id for r in browse.top_share(rows, [F.desc("w"), F.asc("id")], 0.1).orderBy(F.desc("w"), "id").collect()] == [i for i, _ in best[:30]]
    assert browse.top_share(rows.limit(5), [F.asc("id")]).count() == 5 and browse.running(rows.limit(0), [F.asc("id")]).count() == 0


def test_checkpoint(spark, tmp_path):
    at = changes.Checkpoint(spark, str(tmp_path / "point"))
    assert at.load().count() == 0
    state = lambda c, n: spark.createDataFrame([(c, n)], "cursor string, done long")
    at.save(state("b", 2))
    at.save(state("a", 5))
    assert [tuple(r) for r in at.load().collect()] == [("main", "a", 5)]
    at.clear()
    assert at.load().count() == 0
    at.save(state("c", 1))
    assert at.load().first().cursor == "c"


def test_playlists(spark):
    have = spark.createDataFrame([("road-trip", "Road Trip")], "slug string, name string")
    want = spark.createDataFrame([("Road trip!",), ("Calm",), ("calm",), ("!!",)], "name string")
    lists, refused = changes.create_playlists(have, want)
    assert sorted(map(tuple, lists.collect())) == [("calm", "Calm"), ("road-trip", "Road Trip")]
    assert sorted(r.message for r in refused.collect()) == ["slug taken: ", "slug taken: calm", "slug taken: road-trip"]
    entries = spark.createDataFrame([("calm", 1, 0), ("calm", 2, 1)], "slug string, track_id long, position long")
    more = changes.add_entries(entries, spark.createDataFrame([("calm", 9, 0), ("calm", 1, 1), ("calm", 8, 2), ("road-trip", 5, 0), ("calm", 9, 3)], "slug string, track_id long, n long"))
    assert sorted(map(tuple, more.collect())) == [("calm", 1, 0), ("calm", 2, 1), ("calm", 8, 3), ("calm", 9, 2), ("road-trip", 5, 0)]
    left, rest_ = changes.delete_playlists(lists, more, spark.createDataFrame([("calm",)], "slug string"))
    assert [r.slug for r in left.collect()] == ["road-trip"] and [r.slug for r in rest_.collect()] == ["road-trip"]


def test_play_totals(spark):
    df = spark.createDataFrame([(1, 10, T0), (1, 10, T0 + dt.timedelta(hours=1)), (2, 10, T0), (3, None, T0)], "track_id long, release_id long, ts timestamp")
    got = sorted((r.kind, r.id, r.plays) for r in plays.play_totals(df).collect())
    assert got == [("release", 10, 3), ("track", 1, 2), ("track", 2, 1), ("track", 3, 1)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

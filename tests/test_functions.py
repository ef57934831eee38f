"""Worked examples of the column functions."""

import pytest
from pyspark.sql import functions as F

from melisma.functions import arrays, dates, maps, maths, strings
from melisma.operators import browse, explore, matching, quality


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("tag", "main", "featured"),
    [
        ("Artist A,Artist B", ["Artist A", "Artist B"], []),
        ("10,000 Maniacs", ["10,000 Maniacs"], []),
        ("Crosby, Stills & Nash", ["Crosby, Stills & Nash"], []),
        ("Simon & Garfunkel", ["Simon & Garfunkel"], []),
        ("X (feat. Y)", ["X"], ["Y"]),
        ("A // B ; C", ["A", "B", "C"], []),
        ("a/A", ["a"], []),
        ("A feat. A", ["A"], []),
        ("Various Artists", [], []),
        ("Trailing,", ["Trailing,"], []),
        ("A ft B / C featuring D", ["A"], ["B", "C featuring D"]),
        ("A||B\\C|D", ["A", "B", "C", "D"], []),
    ],
)
def test_artist_splitter(spark, tag, main, featured):
    got = value(spark, matching.split_artists(F.lit(tag)))
    assert (got.main, got.featured) == (main, featured)


@pytest.mark.parametrize(("a", "b", "same"), [("3", "Alabama 3", False), ("The Beatles", "Beatles", True), ("Crosby Stills", "Crosby Stills Nash", True), ("A B", "B C", False), ("!!!", "???", True)])
def test_similar_names(spark, a, b, same):
    assert value(spark, matching.similar_names(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: strings.normalise_title(F.lit("Don't  Stop!")), "dont stop"),
        (lambda: strings.ascii_slug(F.lit("Foo & Bar!!")), "foo-bar"),
        (lambda: strings.unicode_slug(F.lit("Ça Va Mañana")), "ca-va-manana"),
        (lambda: strings.unicode_slug(F.lit("ДДТ & Щука")), "ddt-shchuka"),
        (lambda: strings.unicode_slug(F.lit("Ελλάδα Ψ")), "ellada-ps"),
        (lambda: strings.unicode_slug(F.lit("아이유")), "aiyu"),
        (lambda: strings.unicode_slug(F.lit("X Japan ゆず")), "x-japan-yuzu"),
        (lambda: strings.unicode_slug(F.lit("林檎")), "6797-6a8e"),
        (lambda: strings.unicode_slug(F.lit("Straße Ærø")), "strasse-aero"),
        (lambda: strings.genre_tokens(F.lit("Symphonic Black Metal / Industrial/Electronic Metal")), ["symphonic black metal", "industrial/electronic metal"]),
        (lambda: strings.byte_size(F.lit(1023)), "1023 B"),
        (lambda: strings.byte_size(F.lit(1536)), "1.50 KB"),
        (lambda: strings.minutes_seconds(F.lit(200)), "3:20"),
        (lambda: strings.minutes_seconds(F.lit(None).cast("int")), "--:--"),
        (lambda: strings.playtime(F.lit(90061)), "1d 1h 1m"),
        (lambda: strings.playtime(F.lit(59)), "< 1m"),
        (lambda: strings.playtime(F.lit(0)), "0 seconds"),
        (lambda: strings.leading_number(F.lit(" 7 /12")), 7),
        (lambda: strings.strip_controls(F.lit("a\x00b\x85c")), "abc"),
        (lambda: strings.html_escape(F.lit("<a href='x'>&")), "&lt;a href=&#x27;x&#x27;&gt;&amp;"),
        (lambda: strings.phrase_query(F.lit("12 Stones")), "%2212%20Stones%22"),
        (lambda: strings.mime_type(F.lit("x/y.FLAC")), "audio/flac"),
        (lambda: strings.relative_path(F.lit("/m/A/b.mp3"), "/m"), "A/b.mp3"),
        (lambda: dates.year_of_text(F.lit("1999-05-01")), 1999),
        (lambda: dates.year_of_text(F.lit("n/a")), None),
        (lambda: maths.mood(F.lit("-5")), 0),
        (lambda: maths.mood(F.lit("150")), 99),
        (lambda: maths.mood(F.lit("x")), 0),
        (lambda: maths.round_half_up(F.lit(-2.5)), -2),
        (lambda: maths.score_band(F.lit(0.5)), "medium"),
        (lambda: arrays.mean(F.array(F.lit(1.0), F.lit(2.0))), 1.5),
        (lambda: explore.genre_value(F.lit("Downtempo, Instrumental Hip-Hop"), explore.GENRE_ENERGY), 37.5),
        (lambda: explore.genre_value(F.lit("Downtempo, Instrumental Hip-Hop"), explore.GENRE_SOUND), 57.5),
        (lambda: explore.genre_value(F.lit("Alternative Rock / Rapcore / Funk / Ragga-Metal"), explore.GENRE_ENERGY), 61.25),
        (lambda: explore.genre_value(F.lit("Alternative Rock / Rapcore / Funk / Ragga-Metal"), explore.GENRE_SOUND), 45.0),
        (lambda: explore.genre_value(F.lit("Polka"), explore.GENRE_ENERGY), None),
        (lambda: explore.familiarity_score(F.lit(10), 4), pytest.approx(1 - abs(4 / 9 - 0.5))),
    ],
)
def test_examples(spark, column, want):
    assert value(spark, column()) == want


@pytest.mark.parametrize(("year", "want"), [(1997, 1.0), (2003, 0.6), (2009, 0.3), (2011, 0.0), (None, 0.5)])
def test_era(spark, year, want):
    assert value(spark, explore.era_score(F.lit(year).cast("int"), 3)) == want


@pytest.mark.parametrize(("year", "bad"), [("0", True), ("9999", True), ("2030", True), ("abc", True), ("2029", False), ("1997", False), ("  ", False)])
def test_invalid_year(spark, year, bad):
    assert (value(spark, quality.invalid_year(F.lit(year))) is not None) is bad


def test_maps(spark):
    m = F.create_map(F.lit("A"), F.lit(" "), F.lit("MOOD_SAD"), F.lit("3"), F.lit("TITLE"), F.lit("t"))
    row = spark.range(1).select(maps.has_value(m, "a").alias("a"), maps.has_key(m, "a").alias("k"), maps.first_value(m, "A", "MOOD_SAD").alias("f"), maps.has_prefix(m, "mood_").alias("p"), maps.other_tags(m).alias("o")).first()
    assert (row.a, row.k, row.f, row.p, row.o) == (False, True, "3", True, {"MOOD_SAD": "3"})
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "1"), ("A", "2"), ("b", "3"))])
    assert value(spark, maps.upper_keys(pairs)) == {"A": "1", "B": "3"}


def test_parameters():
    assert maths.page_bounds(0, 1000) == (0, 100) and maths.page_bounds(3, 20) == (40, 20)
    assert [maths.slider(x) for x in (-1, 2.5, 9.4, 40)] == [0, 3, 9, 9]
    assert browse.has_more(100, 2, 48) and not browse.has_more(96, 2, 48)


def test_name_range(spark):
    names = spark.createDataFrame([("Talking Heads",), ("The Beatles",), ("Air",), ("Tool",)], "n string")
    assert [r.n for r in names.where(browse.name_range(F.col("n"), None, "ta", "th")).collect()] == ["Talking Heads", "The Beatles"]
    assert [r.n for r in names.where(browse.name_range(F.col("n"), "to", "a", "b")).collect()] == ["Tool"]

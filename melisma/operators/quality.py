"""Rules for the tags of scanned files, drill-down and routing (DQ-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import maps, strings
from melisma.operators import browse

#: For each field its tags, any of which will do.
FIELD_TAGS = {
    "artist": ("ARTIST",),
    "title": ("TITLE",),
    "year": ("YEAR",),
    "mb_artist_id": ("MUSICBRAINZ ARTIST ID", "MUSICBRAINZ_ARTISTID", "MUSICBRAINZARTISTID"),
    "mb_track_id": ("MUSICBRAINZ RELEASE TRACK ID", "MUSICBRAINZ_TRACKID", "MUSICBRAINZTRACKID", "MUSICBRAINZ_RELEASETRACKID"),
    "mb_album_id": ("MUSICBRAINZ ALBUM ID", "MUSICBRAINZ_ALBUMID", "MUSICBRAINZALBUMID", "MUSICBRAINZRELEASEID"),
    "acoustic_id": ("ACOUSTIC_ID", "ACOUSTIC ID", "ACOUSTID_ID", "ACOUSTID ID"),
    "songkong_id": ("SONGKONG_ID", "SONGKONGID"),
    "bandcamp": ("URL_BANDCAMP_ARTIST_SITE", "WWW BANDCAMP_ARTIST"),
    "wikipedia_artist": ("WWW WIKIPEDIA_ARTIST",),
    "discogs_artist": ("URL_DISCOGS_ARTIST_SITE", "WWW DISCOGS_ARTIST"),
    "discogs_release": ("URL_DISCOGS_RELEASE_SITE", "WWW DISCOGS_RELEASE"),
    "genre": ("GENRE",),
    "bpm": ("BPM",),
}
#: The fields of each category of issues.
CATEGORIES = {
    "critical": ("missing_artist", "missing_title", "missing_year", "invalid_year", "blank_artist", "blank_title", "blank_year"),
    "mb": ("missing_mb_artist_id", "missing_mb_track_id", "missing_mb_album_id"),
    "discogs": ("missing_discogs_artist", "missing_discogs_release"),
    "ids": ("missing_acoustic_id", "missing_songkong_id", "missing_bandcamp", "missing_wikipedia_artist"),
    "other": ("missing_genre", "missing_bpm", "missing_mood", "missing_album_art", "blank_genre"),
}
BLANKABLE = ("artist", "title", "year", "genre")
FLAGS = (*(f"missing_{f}" for f in FIELD_TAGS), "missing_mood", "missing_album_art", *(f"blank_{f}" for f in BLANKABLE))
PAGE_ARTISTS = 20


def invalid_year(year: Column) -> Column:
    """A year that is given but no number from 1 to 2029, trimmed; else null (DQ-03)."""
    y = F.trim(year)
    n = y.try_cast("int")
    return F.when((y != "") & (n.isNull() | (n <= 0) | (n >= 2030)), y)


def rules(files: DataFrame, tags: str = "tags", has_art: str = "has_art") -> DataFrame:
    """With the 21 rule fields (DQ-01): flags missing_* and blank_*, and the value invalid_year."""
    m = F.col(tags)
    out = {f"missing_{f}": ~maps.has_value(m, *keys) for f, keys in FIELD_TAGS.items()}
    out |= {"missing_mood": ~maps.has_prefix(m, "MOOD_"), "missing_album_art": ~F.col(has_art)}
    out |= {f"blank_{f}": maps.has_key(m, *FIELD_TAGS[f]) & ~maps.has_value(m, *FIELD_TAGS[f]) for f in BLANKABLE}
    out["invalid_year"] = invalid_year(maps.first_value(m, "YEAR"))
    return files.withColumns(out)


def _raised(field: str) -> Column:
    return F.col(field).isNotNull() if field == "invalid_year" else F.col(field)


def categories(ruled: DataFrame) -> DataFrame:
    """With has_<category> and has_issue (DQ-02)."""
    out = {}
    for name, fields in CATEGORIES.items():
        c = F.lit(False)
        for f in fields:
            c = c | _raised(f)
        out[f"has_{name}"] = c
    some = ruled.withColumns(out)
    any_ = F.lit(False)
    for name in CATEGORIES:
        any_ = any_ | F.col(f"has_{name}")
    return some.withColumn("has_issue", any_)


def issues(ruled: DataFrame, path: str = "path") -> DataFrame:
    """A row an issue: path, category, field, annotation (DQ-05)."""
    rows = []
    for category, fields in CATEGORIES.items():
        for f in fields:
            tab = f.removeprefix("missing_").removeprefix("blank_").removeprefix("invalid_")
            note = F.col("invalid_year") if f == "invalid_year" else F.lit("(blank)" if f.startswith("blank_") else "")
            rows.append(F.when(_raised(f), F.struct(F.lit(category).alias("category"), F.lit(tab).alias("field"), note.alias("annotation"))))
    return ruled.select(path, F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def lone_files(files: DataFrame, path: str = "path") -> DataFrame:
    """With lone: whether a file is the only one of its folder (JN-11)."""
    return files.withColumn("lone", F.count("*").over(Window.partitionBy(strings.parent_folder(F.col(path)))) == 1)


def route(files: DataFrame) -> DataFrame:
    """path, readable, has_issue, had_issue, lone -> path, destination (DQ-08); rows without need of one are left out."""
    where = F.when(~F.col("readable"), "unreadable").when(F.col("had_issue") & ~F.col("has_issue"), "autofixed").when(F.col("has_issue") & F.col("lone"), "needs-review").when(F.col("has_issue"), "quarantine")
    return files.select("path", where.alias("destination")).where("destination is not null")


def restored_path(path: Column, staging: str) -> Column:
    """The place that a staged file came from (DQ-09)."""
    return strings.relative_path(path, staging)


def repairs(before: DataFrame, after: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """path, flag of what was raised before and isn't any more (DQ-06, JN-17). One row a path on either side."""
    was = before.select("path", F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]).alias("b"))
    now = after.select("path", F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]).alias("a"))
    gone = F.filter(F.array_except("b", "a"), lambda f: f.isNotNull())
    return was.join(now, "path").select("path", F.explode(gone).alias("flag"))


def spread_reasons(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """path of each file under a skipped folder, with its reason (DQ-07). skipped: folder, reason."""
    return files.withColumn("folder", strings.parent_folder(F.col("path"))).join(skipped, "folder").select("path", "reason")


def fix_status(skipped: Column, matched: Column) -> Column:
    """What became of a file's field (DQ-10)."""
    return F.when(skipped.isNotNull(), F.concat(F.lit("skipped: "), skipped)).when(matched, "matched").otherwise("none")


def ok_files(total: Column, errors: Column, with_issues: Column) -> Column:
    return F.greatest(F.lit(0), total - errors - with_issues)


def report_pages(artists: DataFrame, name: str = "artist", per_page: int = PAGE_ARTISTS) -> DataFrame:
    """Distinct names with their page (WIN-05)."""
    placed = browse.running(artists.select(name).distinct(), [F.asc(name)])
    return placed.select(name, (F.floor((F.col("_place") - 1) / per_page) + 1).cast("long").alias("page"))

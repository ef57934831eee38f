"""Artist names and release matching (ENT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import arrays, strings

#: Names that stand for no single artist.
VARIOUS = ("various artists", "various", "va")
#: Separators of compound names, in the order in which they are tried.
SEPARATORS = (", ", " & ", " vs ", " vs. ", " feat ", " feat. ", " – ")
_FEATURING = r"(?i)\s*\(\s*feat(?:uring)?\.?\s+|\s+feat(?:uring)?\.?\s+|\s*\(\s*ft\.?\s+|\s+ft\.?\s+"
_DELIMITER = r"//|\\\\|\|\||[/;\\|]|,(?=[^\s0-9])"


def is_various(name: Column) -> Column:
    return F.lower(name).isin(*VARIOUS)


def _names(part: Column) -> Column:
    pieces = F.transform(F.split(part, _DELIMITER), lambda x: F.trim(x))
    return arrays.distinct_ignoring_case(F.filter(pieces, lambda x: (x != "") & ~is_various(x)))


def split_artists(tag: Column) -> Column:
    """struct(main, featured) of an artist tag (ENT-01).

    The first marker of featured artists divides the tag; each side splits at slashes, semicolons, bars and at commas
    with neither space nor digit after them. Spellings of a name count once, and who is a main artist isn't featured.
    """
    halves = F.split(tag, _FEATURING, 2)
    marker = F.regexp_extract(tag, f"({_FEATURING})", 1)
    right = F.when(F.contains(marker, F.lit("(")), F.trim(F.regexp_replace(F.get(halves, F.lit(1)), r"\)+$", ""))).otherwise(F.get(halves, F.lit(1)))
    main = _names(F.get(halves, F.lit(0)))
    featured = F.coalesce(_names(right), F.array().cast("array<string>"))
    return F.when(tag.isNotNull(), F.struct(main.alias("main"), arrays.without_ignoring_case(featured, main).alias("featured")))


def canonical_artist(album_artists: Column, track_artists: Column) -> Column:
    return F.coalesce(F.get(album_artists, F.lit(0)), F.get(track_artists, F.lit(0)), F.lit("Unknown Artist"))


def roles(tracks: DataFrame) -> DataFrame:
    """track_id, album_artists, track_artists, featured -> distinct (track_id, name, role) (ENT-03).

    A track without album artists or track artists takes the canonical artist in their place.
    """
    who = canonical_artist(F.col("album_artists"), F.col("track_artists"))
    pick = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(who))
    entry = lambda arr, role: F.transform(arr, lambda n: F.struct(n.alias("name"), F.lit(role).alias("role")))
    every = F.concat(entry(pick("album_artists"), "ALBUM_ARTIST"), entry(pick("track_artists"), "PRIMARY"), entry(F.col("featured"), "FEATURED"))
    return tracks.select("track_id", F.explode(every).alias("r")).select("track_id", "r.name", "r.role").distinct()


def similar_names(a: Column, b: Column) -> Column:
    """Equal when normalised; or both of several words and sharing at least half of them (ENT-04)."""
    x, y = strings.normalise_artist(a), strings.normalise_artist(b)
    words = lambda s: F.filter(F.split(s, " "), lambda w: w != "")
    wx, wy = words(x), words(y)
    return (x == y) | ((F.size(wx) != 1) & (F.size(wy) != 1) & (arrays.jaccard(wx, wy) >= 0.5))


def first_acceptable(hits: DataFrame, keys: list[str], query: str, name: str, score: str, rank: str, least: int = 90) -> DataFrame:
    """Of each key's ranked hits the first with score and name good enough (ENT-05, WIN-11)."""
    good = hits.where((F.coalesce(F.col(score), F.lit(0)) >= least) & similar_names(F.col(query), F.col(name)))
    others = [c for c in hits.columns if c not in keys]
    return good.groupBy(*keys).agg(F.min(F.struct(F.col(rank).alias("_rank"), *others)).alias("m")).select(*keys, *[f"m.{c}" for c in others])


def fallback_queries(artists: DataFrame) -> DataFrame:
    """artist_id, name, raw_artist, raw_album_artist -> ranked names to search for (ENT-06): stage, sep_ix, piece_ix, text."""
    name = F.col("name")
    one = lambda stage, text: F.array(F.struct(F.lit(stage).alias("stage"), F.lit(-1).alias("sep_ix"), F.lit(0).alias("piece_ix"), text.alias("text")))
    none = F.array().cast("array<struct<stage:int,sep_ix:int,piece_ix:int,text:string>>")
    raw = F.trim(F.col("raw_artist"))
    second = F.when(raw.isNotNull() & (raw != "") & (F.lower(raw) != F.lower(name)), one(2, raw)).otherwise(none)
    source = F.coalesce(F.col("raw_album_artist"), name)

    def pieces(ix: int, sep: str) -> Column:
        parts = F.filter(F.transform(F.split(source, f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")
        entries = F.transform(parts, lambda x, i: F.struct(F.lit(3).alias("stage"), F.lit(ix).alias("sep_ix"), i.alias("piece_ix"), x.alias("text")))
        return F.when(F.size(parts) >= 2, F.filter(entries, lambda e: F.lower(e["text"]) != F.lower(name))).otherwise(none)

    every = F.concat(one(1, name), second, *[pieces(i, s) for i, s in enumerate(SEPARATORS)])
    return artists.select("artist_id", "name", F.inline(every))


def match_status(reference: DataFrame, local: DataFrame) -> DataFrame:
    """How complete each reference release is locally (ENT-07).

    reference: ref_id, artist_id, title, tracks (array of titles); local: local_id, artist_id, title, tracks. A local
    release belongs to a reference release of the same artist and title, case aside; of several the lowest id counts.
    Returns ref_id, local_id, status, missing, extra, score.
    """
    key = F.lower(F.col("title"))
    chosen = local.withColumn("k", key).groupBy("artist_id", "k").agg(F.min(F.struct("local_id", "tracks")).alias("l"))
    both = reference.withColumn("k", key).join(chosen, ["artist_id", "k"], "left")
    norm = lambda arr: F.transform(arr, lambda t: strings.normalise_title(t))
    ref, loc = norm(F.coalesce(F.col("tracks"), F.array().cast("array<string>"))), norm(F.coalesce(F.col("l.tracks"), F.array().cast("array<string>")))
    counted = both.select("ref_id", F.col("l.local_id").alias("local_id"), ref.alias("r"), loc.alias("o"))
    missing = F.size(F.filter("r", lambda t: ~F.array_contains(F.col("o"), t)))
    extra = F.size(F.filter("o", lambda t: ~F.array_contains(F.col("r"), t)))
    counted = counted.select("ref_id", "local_id", F.size("r").alias("n"), missing.alias("m"), extra.alias("e"))
    status = F.when(F.col("local_id").isNull(), "MISSING").when((F.col("m") == 0) & (F.col("e") == 0), "COMPLETE").when(F.col("m") == 0, "EXTRA_TRACKS").otherwise("INCOMPLETE")
    score = F.when(F.col("local_id").isNull(), 0.0).when(F.col("m") == 0, 1.0).otherwise((F.col("n") - F.col("m")) / F.col("n"))
    gone = F.when(F.col("local_id").isNull(), F.col("n")).otherwise(F.col("m"))
    return counted.select("ref_id", "local_id", status.alias("status"), gone.alias("missing"), F.col("e").alias("extra"), score.alias("score"))


def artist_outcome(scores: DataFrame) -> DataFrame:
    """artist_id, score (null: release without editions), failed -> mean score and outcome of a sync (ENT-08, AGG-19)."""
    n, bad = F.count("*"), F.count_if(F.col("failed"))
    outcome = F.when(bad == 0, "full").when(bad < n, "partial").otherwise("failed")
    return scores.groupBy("artist_id").agg(F.avg("score").alias("average"), n.alias("releases"), bad.alias("failures"), outcome.alias("outcome"))


def relink(artists: DataFrame) -> DataFrame:
    """artist_id, slug, mbid -> primary_id: the first artist, by slug, with the same outside id (WIN-12, ENT-09)."""
    w = Window.partitionBy("mbid").orderBy("slug", "artist_id")
    return artists.withColumn("primary_id", F.when(F.col("mbid").isNull(), F.col("artist_id")).otherwise(F.first("artist_id").over(w)))


def compound_name(name: Column) -> Column:
    """Whether a name looks like several artists (FLT-18)."""
    return name.rlike(r"(?i)//|\\|\||;|/| feat\.? | ft\.? | featuring |\(feat|\(ft") | name.rlike(r",[^ 0-9]")

"""Scoring tracks against four sliders and drawing one (EXP-*)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.functions import maths, strings
from melisma.operators import browse

#: Energy of a genre, 0 to 100.
GENRE_ENERGY = {
    "ambient": 10, "new age": 10, "chillout": 15, "lounge": 15, "downtempo": 20, "classical": 15, "sleep": 5,
    "folk": 25, "acoustic": 25, "singer-songwriter": 25, "bossa nova": 25, "jazz": 30, "blues": 30, "soul": 35,
    "country": 30, "soft rock": 30, "trip-hop": 30, "shoegaze": 35, "dream pop": 30,
    "r&b": 40, "reggae": 40, "indie": 40, "pop": 45, "art rock": 45, "alternative": 45, "synthpop": 45, "funk": 50,
    "pop rock": 45, "indie rock": 45, "new wave": 45, "fusion": 45, "progressive rock": 50,
    "rock": 55, "hip-hop": 55, "hip hop": 55, "rap": 60, "trap": 60, "hard rock": 65, "punk rock": 65, "post-punk": 55,
    "grunge": 60, "garage rock": 65, "southern rock": 55, "stoner rock": 55, "alternative rock": 55, "post-grunge": 60,
    "rapcore": 65,
    "metal": 75, "heavy metal": 75, "alternative metal": 70, "nu metal": 75, "industrial": 75, "punk": 70,
    "hardcore": 80, "industrial metal": 80, "noise rock": 70, "funk metal": 70, "drum and bass": 80, "hardstyle": 85,
    "gabber": 90,
    "black metal": 90, "death metal": 90, "thrash metal": 85, "chaotic hardcore": 90, "grindcore": 95,
    "power metal": 80, "speed metal": 90, "metalcore": 85, "deathcore": 90,
}

#: Sound of a genre, 0 acoustic to 100 electronic.
GENRE_SOUND = {
    "acoustic": 5, "folk": 10, "singer-songwriter": 10, "classical": 5, "bossa nova": 10, "country": 15, "blues": 15,
    "acoustic rock": 15, "unplugged": 5,
    "jazz": 25, "soul": 30, "r&b": 35, "soft rock": 25, "art rock": 35, "southern rock": 25, "reggae": 30,
    "rock": 40, "pop": 50, "indie": 45, "alternative": 45, "pop rock": 45, "hard rock": 40, "funk": 40, "hip-hop": 55,
    "hip hop": 55, "alternative rock": 40, "progressive rock": 45, "post-punk": 50, "grunge": 40, "new wave": 55,
    "metal": 40, "punk rock": 35, "punk": 35,
    "synthpop": 70, "industrial": 75, "industrial metal": 65, "trip-hop": 65, "rap": 60, "trap": 70, "nu metal": 55,
    "drum and bass": 80, "downtempo": 60, "dream pop": 55, "noise rock": 50, "shoegaze": 50,
    "electronic": 90, "edm": 95, "techno": 95, "house": 90, "ambient": 75, "chillout": 70, "trance": 90, "dubstep": 85,
    "hardstyle": 90, "gabber": 95,
}


@dataclass(frozen=True)
class Energy:
    bpm: tuple[int, int]
    moods: dict[str, int]


#: Tempo range and mood targets of the energy slider's places.
ENERGY = (
    Energy((60, 85), {"RELAXED": 90, "SAD": 30, "HAPPY": 10, "AGGRESSIVE": 0, "PARTY": 0}),
    Energy((65, 95), {"SAD": 80, "RELAXED": 50, "HAPPY": 5, "AGGRESSIVE": 5, "PARTY": 0}),
    Energy((70, 100), {"RELAXED": 85, "HAPPY": 30, "AGGRESSIVE": 0, "PARTY": 5}),
    Energy((80, 115), {"RELAXED": 60, "VALENCE": 30, "AGGRESSIVE": 5, "PARTY": 10}),
    Energy((85, 120), {"RELAXED": 50, "HAPPY": 50, "DANCEABILITY": 40, "AGGRESSIVE": 5}),
    Energy((95, 130), {"DANCEABILITY": 70, "PARTY": 60, "HAPPY": 65, "SAD": 5}),
    Energy((110, 145), {"HAPPY": 80, "PARTY": 75, "DANCEABILITY": 80, "SAD": 0}),
    Energy((120, 160), {"PARTY": 85, "AROUSAL": 85, "DANCEABILITY": 85, "RELAXED": 5}),
    Energy((135, 180), {"AGGRESSIVE": 90, "AROUSAL": 90, "HAPPY": 60, "RELAXED": 0}),
    Energy((145, 200), {"AGGRESSIVE": 95, "AROUSAL": 95, "PARTY": 70, "RELAXED": 0}),
)
#: Years of the era slider's places.
ERA = ((1960, 1969), (1970, 1979), (1980, 1989), (1990, 1999), (2000, 2004), (2005, 2009), (2010, 2014), (2015, 2019), (2020, 2024), (2025, 2030))
#: Acoustic and electronic targets of the sound slider's places.
SOUND = ((90, 5), (80, 10), (70, 20), (55, 35), (45, 45), (35, 55), (25, 65), (15, 78), (8, 88), (5, 95))


def _lookup_token(token: Column, table: dict[str, int]) -> Column:
    """The token's own value, else that of the longest key within it (of equally long ones the first); null if none."""
    keys = F.array(*[F.struct(F.lit(len(k)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for i, (k, v) in enumerate(table.items())])
    exact = F.get(F.filter(keys, lambda e: e["k"] == token), F.lit(0))["v"]
    return F.coalesce(exact, F.array_max(F.filter(keys, lambda e: F.contains(token, e["k"])))["v"])


def genre_value(genre: Column, table: dict[str, int]) -> Column:
    """The mean over a genre tag's terms that the table knows; null if it knows none (EXP-02)."""
    found = F.filter(F.transform(strings.genre_tokens(genre), lambda t: _lookup_token(t, table)), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))


def _near(value: Column, place: int) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(value - place / 9 * 100) / 60)


def energy_score(meta: Column, energy: Column, place: int) -> Column:
    """Half tempo, half mood, times the mean confidence in the two (EXP-03). energy: the genre's, maybe null.

    An unreadable tempo counts as no tempo.
    """
    lo, hi = ENERGY[place].bpm
    bpm = maths.leading_int(F.try_element_at(meta, F.lit("IntegerBpm"))).cast("double")
    off = F.when(bpm < lo, lo - bpm).otherwise(bpm - hi)
    tempo = F.when(bpm.between(lo, hi), 1.0).when(off <= 15, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - off / 50))
    by_genre = F.when(energy.isNotNull(), _near(energy, place)).otherwise(0.5)
    trust = F.when(energy.isNotNull(), 0.75).otherwise(0.5)
    has_mood = F.try_element_at(meta, F.lit("MOOD_HAPPY")).isNotNull()
    moods = [1 - F.abs(maths.mood(F.try_element_at(meta, F.lit(f"MOOD_{k}"))) - v) / 100 for k, v in ENERGY[place].moods.items()]
    feeling = sum(moods[1:], moods[0]) / len(moods)
    a, ca = F.when(bpm.isNotNull(), tempo).otherwise(by_genre), F.when(bpm.isNotNull(), 1.0).otherwise(trust)
    b, cb = F.when(has_mood, feeling).otherwise(by_genre), F.when(has_mood, 1.0).otherwise(trust)
    return (a * 0.5 + b * 0.5) * ((ca + cb) / 2)


def era_score(year: Column, place: int) -> Column:
    lo, hi = ERA[place]
    off = F.least(F.abs(year - lo), F.abs(year - hi))
    return F.when(year.isNull(), 0.5).when(year.between(lo, hi), 1.0).when(off <= 5, 0.6).when(off <= 10, 0.3).otherwise(0.0)


def familiarity_score(plays: Column, place: int) -> Column:
    score = 1 - F.abs(F.lit(place / 9) - (1 - F.least(plays / 20, F.lit(1.0))))
    return F.when((plays > 0) & F.lit(place == 9), 0.0).otherwise(score)


def sound_score(meta: Column, sound: Column, place: int) -> Column:
    """From two mood tags, else from the genre's sound at three quarters, else a quarter (EXP-06)."""
    acoustic, electronic = SOUND[place]
    tag = lambda k: maths.mood(F.try_element_at(meta, F.lit(k)))
    by_mood = 1 - (F.abs(tag("MOOD_ACOUSTIC") - acoustic) / 100 + F.abs(tag("MOOD_ELECTRONIC") - electronic) / 100) / 2
    return F.when(F.try_element_at(meta, F.lit("MOOD_ACOUSTIC")).isNotNull(), by_mood).when(sound.isNotNull(), _near(sound, place) * 0.75).otherwise(0.25)


def scored(tracks: DataFrame, energy: int, era: int, familiarity: int, sound: int) -> DataFrame:
    """With column score (EXP-01). tracks: genre, year, play_count, metadata (map)."""
    known = tracks.withColumn("_e", genre_value(F.col("genre"), GENRE_ENERGY)).withColumn("_s", genre_value(F.col("genre"), GENRE_SOUND))
    total = energy_score(F.col("metadata"), F.col("_e"), energy) * 0.4 + era_score(F.col("year"), era) * 0.2 + familiarity_score(F.col("play_count"), familiarity) * 0.2 + sound_score(F.col("metadata"), F.col("_s"), sound) * 0.2
    return known.withColumn("score", total).drop("_e", "_s")


def candidates(tracks: DataFrame, era: int, familiarity: int, exclude: list[str] | None = None) -> DataFrame:
    """Rows that may be drawn (FLT-08, 09, 10): years within ten of the era or unknown, not excluded, unplayed if asked for."""
    lo, hi = ERA[era]
    keep = F.col("year").isNull() | F.col("year").between(lo - 10, hi + 10)
    if exclude:
        keep = keep & ~F.col("id").isin(exclude)
    if familiarity == 9:
        keep = keep & (F.col("play_count") == 0)
    return tracks.where(keep)


def sampled(rows: DataFrame, key: str, n: int = 500, seed: int = 0) -> DataFrame:
    """A seeded random sample of n rows (SRT-10): the rows with the least keyed hashes."""
    return rows.orderBy(*browse.seeded(key, seed)).limit(n)


def weighted_pick(rows: DataFrame, key: str, u: float, share: float = 0.15, least: int = 20) -> DataFrame:
    """One row of the best rows, with a chance by the square of its score (WIN-06, WIN-07). u: a draw from [0, 1).

    Scores count to nine decimals, so that no order hangs on rounding. Any number of rows: the running sum goes by
    ranges of the order.
    """
    best = browse.top_share(rows.withColumn("score", F.round("score", 9)), [F.desc("score"), F.asc(key)], share, least)
    run = browse.running(best.withColumn("_w", F.col("score") * F.col("score")), [F.desc("score"), F.asc(key)], "_w")
    hit = F.when(F.col("_whole") > 0, F.col("_run") >= F.col("_whole") * u).otherwise(F.col("_place") >= F.floor(F.col("_n") * u) + 1)
    return run.where(hit).orderBy("_place").limit(1).drop("_w", "_run", "_whole", "_place", "_n")


def pick(tracks: DataFrame, energy: int, era: int, familiarity: int, sound: int, u: float, exclude: list[str] | None = None, seed: int = 0, most: int = 500) -> DataFrame:
    """One track for four sliders, or none (EXP-08)."""
    places = [maths.slider(x) for x in (energy, era, familiarity, sound)]
    pool = sampled(candidates(tracks, places[1], places[2], exclude), "id", most, seed)
    return weighted_pick(scored(pool, *places), "id", u)

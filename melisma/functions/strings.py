"""Text functions (STR-*). Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_slug(s: Column) -> Column:
    """Lower case, anything but a-z and 0-9 becomes one dash, no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


#: Latin spellings of Cyrillic and Greek small letters, and of Latin ones that don't decompose.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "є": "ie", "і": "i", "ї": "i", "ґ": "g", "ў": "u", "ђ": "d", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh", "ѕ": "dz",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng",
}


def _speller(letters: dict[str, str]):
    """A function from a text to its letters in Latin ones: by the table, by decomposition, by the syllable that a letter's
    Unicode name ends in, or, for ideographs and all else, by code point, so that different names stay different. It
    carries all it needs to other machines."""
    kinds = ("HANGUL SYLLABLE ", "HIRAGANA LETTER SMALL ", "HIRAGANA LETTER ", "KATAKANA LETTER SMALL ", "KATAKANA LETTER ")
    known: dict[str, str] = {}

    def one(c: str) -> str:
        if c in letters:
            return letters[c]
        if c.isascii():
            return c
        if unicodedata.combining(c) or not c.isalnum():
            return "" if unicodedata.combining(c) else " "
        name = unicodedata.name(c, "")
        for kind in kinds:
            if name.startswith(kind):
                return name.removeprefix(kind).lower()
        plain = unicodedata.normalize("NFKD", c)
        if plain != c:
            return "".join(map(one, plain))
        return "".join(map(one, c.lower())) if c.lower() != c else f" {ord(c):x} "

    def spell(text: str) -> str:
        if text.isascii():
            return text
        for c in set(text) - known.keys():
            known[c] = one(c)
        return "".join(map(known.__getitem__, text))

    return spell


def _folder():
    spell = _speller(LETTERS)

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else spell(x))

    return fold


_fold = _folder()


def unicode_slug(s: Column) -> Column:
    """Slug in Latin letters: accents go, other alphabets and syllables are spelled out, ideographs keep their code points."""
    return ascii_slug(_fold(s))


def _collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalise_title(s: Column) -> Column:
    """Lower case; letters, digits and single spaces only."""
    return _collapse(F.regexp_replace(F.lower(s), r"(?U)[^\p{L}\p{N}\s]", ""))


def normalise_artist(s: Column) -> Column:
    """As for titles, without a leading article."""
    return normalise_title(F.regexp_replace(F.lower(s), "^the ", ""))


def genre_tokens(s: Column) -> Column:
    """Terms of a genre tag: split at spaced slashes and at commas; trimmed, lower case, none empty."""
    return F.filter(F.transform(F.split(s, r"\s/\s|,\s*"), lambda g: F.lower(F.trim(g))), lambda g: g != "")


def strip_controls(s: Column) -> Column:
    return F.regexp_replace(s, r"[\x00-\x1F\x7F-\x9F]", "")


def leading_number(s: Column) -> Column:
    """The n of "n/total"; null if it is no integer."""
    return F.trim(F.substring_index(s, "/", 1)).try_cast("int")


def content_hash(artist: Column, album_artist: Column, album: Column, title: Column, year: Column, track: Column, disc: Column, genre: Column) -> Column:
    """MD5 of what identifies a recording's tags; nulls count as empty or 0."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return F.md5(F.concat_ws("|", text(artist), text(album_artist), text(album), text(title), number(year), number(track), number(disc), text(genre)))


def relative_path(path: Column, root: str) -> Column:
    cut = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    return F.regexp_replace(cut, "^/+", "")


def first_folder(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def parent_folder(path: Column) -> Column:
    """Null for a path without a slash."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def _binary(n: Column, power: int, unit: str) -> Column:
    """n / 2**power with two decimals, ties to even, as C and Rust print it: Java rounds the shortest decimals half up."""
    n = F.coalesce(n.cast("double").try_cast("long"), n)
    part = n.bitwiseAND(F.lit((1 << power) - 1).cast("long")) * 100
    cents, rest, half = F.shiftright(part, power), part.bitwiseAND(F.lit((1 << power) - 1).cast("long")), 1 << (power - 1)
    cents = cents + ((rest > half) | ((rest == half) & (cents % 2 == 1))).cast("long")
    return F.format_string(f"%d.%02d {unit}", F.shiftright(n, power) + (cents == 100).cast("long"), cents % 100)


def byte_size(n: Column, largest: str = "TB") -> Column:
    """1024-based, two decimals from KB on, in units up to the largest one."""
    n = n.cast("long")
    out = F.format_string("%d B", n)
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB"), (40, "TB")):
        out = F.when(n >= (1 << power), _binary(n, power, unit)).otherwise(out)
        if unit == largest:
            break
    return F.when(n.isNotNull(), out)


def minutes_seconds(seconds: Column) -> Column:
    """m:ss; dashes for null and 0."""
    s = seconds.cast("long")
    return F.when(F.coalesce(s, F.lit(0)) == 0, "--:--").otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def playtime(seconds: Column) -> Column:
    """Days, hours and minutes that aren't 0."""
    s = seconds.cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    parts = F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s % 86400 / 3600), "h"), part(F.floor(s % 3600 / 60), "m"))
    return F.when(F.coalesce(s, F.lit(0)) == 0, "0 seconds").when(parts == "", "< 1m").otherwise(parts)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


#: Extensions and their media types.
MIME = {"mp3": "audio/mpeg", "flac": "audio/flac", "m4a": "audio/mp4", "aac": "audio/aac", "ogg": "audio/ogg", "opus": "audio/opus", "wav": "audio/wav"}


def mime_type(path: Column) -> Column:
    out = F.lit("audio/mpeg")
    for ext, kind in MIME.items():
        out = F.when(F.lower(extension(path)) == ext, kind).otherwise(out)
    return out


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def phrase_query(s: Column) -> Column:
    """A quoted phrase, percent-encoded."""
    return F.replace(F.url_encode(F.concat(F.lit('"'), s, F.lit('"'))), F.lit("+"), F.lit("%20"))


def initial(s: Column) -> Column:
    return F.upper(F.substring(s, 1, 1))

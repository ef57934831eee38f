"""Functions of tag maps (MAP-*). Keys of a map are upper case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that have columns of their own.
OWN_COLUMNS = ("ARTIST", "TITLE", "ALBUM", "YEAR", "DATE", "GENRE", "TRACKNUMBER", "TRACK", "DISCNUMBER", "DISC", "ALBUMARTIST", "ALBUM_ARTIST", "ALBUM ARTIST")


def _blank(v: Column) -> Column:
    return F.trim(F.coalesce(v, F.lit(""))) == ""


def value(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key.upper()))


def has_value(m: Column, *keys: str) -> Column:
    """Any of the keys has a value that isn't blank."""
    out = F.lit(False)
    for k in keys:
        out = out | ~_blank(value(m, k))
    return out


def first_value(m: Column, *keys: str) -> Column:
    """The first value, by order of the keys, that isn't blank."""
    return F.coalesce(*[F.when(~_blank(value(m, k)), value(m, k)) for k in keys])


def has_key(m: Column, *keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(F.map_contains_key(m, F.lit(k.upper())), F.lit(False))
    return out


def has_prefix(m: Column, prefix: str) -> Column:
    return F.coalesce(F.exists(F.map_entries(m), lambda e: e["key"].startswith(prefix.upper()) & ~_blank(e["value"])), F.lit(False))


def other_tags(m: Column) -> Column:
    """Without the tags that have columns of their own, and without blanks."""
    return F.map_filter(m, lambda k, v: ~F.upper(k).isin(*OWN_COLUMNS) & ~_blank(v))


def upper_keys(entries: Column) -> Column:
    """A map from an array of (key, value) by upper-case key; the first value of a key wins."""
    keyed = F.transform(entries, lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(keyed, lambda e: e["key"])
    return F.map_from_entries(F.filter(keyed, lambda e, i: F.array_position(names, e["key"]) == i + 1))

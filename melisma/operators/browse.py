"""Predicates, sorts and pages of the browsing queries (FLT-*, PRJ-*, SRT-*, WIN-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import maths
from melisma.sources.folders import work_folder

#: Release types that a sync leaves out, and link types with an icon of their own.
SKIPPED_TYPES = ("single", "bootleg", "demo", "interview", "broadcast")


def contains_text(c: Column, text: str) -> Column:
    """Case aside; no wildcards."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def all_of(*predicates: Column | None) -> Column:
    """The conjunction of what is given (FLT-04)."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def score_between(c: Column, lo: int | None, hi: int | None) -> Column | None:
    """Percent bounds on a fraction, ends included (FLT-05); rows without a score drop out if either is given."""
    if lo is None and hi is None:
        return None
    return all_of(None if lo is None else c >= lo / 100, None if hi is None else c <= hi / 100)


def name_range(c: Column, only: str | None = None, lo: str | None = None, hi: str | None = None) -> Column:
    """Folder filter (FLT-13, FLT-15): a prefix, or else a range whose upper end includes all that begins with it."""
    low = F.lower(c)
    if only:
        return low.startswith(only.lower())
    return all_of(None if lo is None else low >= lo.lower(), None if hi is None else low <= hi.lower() + "\U0010ffff")


def in_period(year: Column, first: int, years: int = 10) -> Column:
    """Half open (FLT-07)."""
    return (year >= first) & (year < first + years)


def in_dates(c: Column, first: int, years: int = 10) -> Column:
    """The same period as bounds on a timestamp without zone, which a scan can use to skip files (FLT-07)."""
    at = lambda y: F.expr(f"TIMESTAMP_NTZ'{y:04d}-01-01 00:00:00'")
    return (c >= at(first)) & (c < at(first + years))


def skipped_type(primary: Column, secondary: Column) -> Column:
    """Whether a release is of a type to leave out (FLT-17)."""
    return F.coalesce(F.lower(primary).isin(*SKIPPED_TYPES), F.lit(False)) | F.coalesce(F.exists(secondary, lambda t: F.lower(t).isin(*SKIPPED_TYPES)), F.lit(False))


def split_links(links: Column, known: list[str]) -> tuple[Column, Column]:
    """Links of known types, and the others (FLT-26)."""
    is_known = lambda x: F.coalesce(F.lower(x["type"]).isin(*known), F.lit(False))
    return F.filter(links, is_known), F.filter(links, lambda x: ~is_known(x))


def first_given(*values: Column) -> Column:
    """The first text that is neither null nor empty (PRJ-01, CND-01)."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def image_url(remote: Column, local: Column, use_remote: bool, base: str) -> Column:
    """The remote address if used and given, else the local path, else null (PRJ-03)."""
    here = F.when(F.nullif(local, F.lit("")).isNotNull(), F.concat(F.lit(base), local))
    return F.coalesce(F.nullif(remote, F.lit("")), here) if use_remote else here


#: The orders that a list of artists can have (SRT-02); each ends with a unique key.
def artist_order(sort: str, key: str = "id") -> list[Column]:
    first = {"name": [F.asc("name")], "playCount": [F.desc_nulls_last("play_count")], "score": [F.desc_nulls_first("score")], "recent": [F.desc_nulls_last("created_at")]}
    return [*first.get(sort, first["name"]), F.asc(key)]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 48) -> DataFrame:
    """One page of ordered rows (SRT-05)."""
    skip, take = maths.page_bounds(number, size)
    return rows.orderBy(*order).offset(skip).limit(take)


def has_more(total: int, number: int, size: int) -> bool:
    return number * size < total


def first_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group (WIN-01 to 04, WIN-10)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def next_in_queue(rows: DataFrame, by: list[str], order: list[Column], key: str) -> DataFrame:
    """With next_<key>: the following row's, after the last the first's (WIN-08)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(f"next_{key}", F.coalesce(F.lead(key).over(w), F.first(key).over(w)))


def previous_or_restart(rows: DataFrame, by: list[str], order: list[Column], key: str, elapsed: str, after: float = 3.0) -> DataFrame:
    """With previous_<key>: the row's own once it has played a while, else the one before it (WIN-09)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(f"previous_{key}", F.when(F.col(elapsed) > after, F.col(key)).otherwise(F.coalesce(F.lag(key).over(w), F.col(key))))


def seeded(key: str, seed: int) -> list[Column]:
    """A random order that the seed fixes."""
    return [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded shuffle (SRT-09)."""
    return rows.orderBy(*seeded(key, seed))


def running(rows: DataFrame, order: list[Column], weight: str | None = None) -> DataFrame:
    """With _place (from 1), _n (rows) and, for a weight, _run and _whole: its running and its whole sum.

    The order is dealt out by ranges, so no task sees all rows; one row a range adds up what came before it. The ranges
    go by samples that differ from run to run, so the rows are written with their range before both are read. The order
    must be unique.
    """
    spark = rows.sparkSession
    value = F.col(weight) if weight else F.lit(0.0)
    dealt = rows.withColumn("_v", value.cast("double")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_place", F.count("*").over(inside)).withColumn("_run", F.sum("_v").over(inside))
    at = work_folder(spark, "ranks")
    dealt.write.parquet(at)
    dealt = spark.read.schema(dealt.schema).parquet(at)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_v").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # as many rows as ranges
    offsets = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_s0"), F.sum("_rows").over(everything).alias("_n"), F.sum("_sum").over(everything).alias("_whole"))
    out = dealt.join(F.broadcast(offsets), "_part").withColumn("_place", F.col("_place") + F.col("_r0")).withColumn("_run", F.col("_run") + F.col("_s0"))
    return out.drop("_part", "_r0", "_s0", "_v", *([] if weight else ["_run", "_whole"]))


def top_share(rows: DataFrame, order: list[Column], share: float = 0.15, least: int = 20) -> DataFrame:
    """The best share of all rows, but so many at least (WIN-06)."""
    placed = running(rows, order)
    return placed.where(F.col("_place") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share))).drop("_place", "_n")


def random_row(rows: DataFrame, key: str, u: float) -> DataFrame:
    """The row at place floor(u * n) by key (SRT-08): one count, then one row."""
    return rows.orderBy(key).offset(int(u * rows.count())).limit(1)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order (JN-08)."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *others), order).alias("m")).select(key, "m.*")


def nullsafe_any(*predicates: Column) -> Column:
    """Disjunction in which unknown counts as false (FLT-06)."""
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in predicates])

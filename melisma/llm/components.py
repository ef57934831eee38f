"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def _toward(edges: DataFrame, least: Column, keep: Column) -> DataFrame:
    """Edges (u, v) -> (v, least neighbour of u): the minimum is aggregated and joined back, so that a hub's rows can be
    dealt out over many tasks."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(v, comp) for each vertex that has a link to another: comp is the least vertex of its component.

    Repeated links, links in both directions and self links are fine; links with a null end are none. Each round's
    edges are written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = links.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")).where("a > b").distinct()
    edges = C.cut(edges)
    last = (-1, 0)
    for _ in range(rounds):
        now = _state(edges)
        if now == last or not now[0]:
            break
        last = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _toward(both, F.col("m"), F.col("v") > F.col("u")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = C.cut(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())

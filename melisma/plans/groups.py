"""WIN-*: per-group and window-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import browse, explore, matching, quality
from melisma.plans.registry import query, table


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) WHERE r <= 4")
def win01_first4(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return browse.first_per_group(rows, ["conv_id"], [F.asc("turn"), F.asc("role")], 4).select("conv_id", "turn")


@query("SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1")
def win02_first_child(spark, d):
    return browse.first_per_group(table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("first")), ["o_custkey"], [F.asc("first")])


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY nullif(l_linenumber, 1) ASC NULLS LAST, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def win03_distinct_on(spark, d):
    order = [F.asc_nulls_last(F.nullif(F.col("l_linenumber"), F.lit(1))), F.asc("l_partkey"), F.asc("l_suppkey")]
    return browse.first_per_group(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT user_id, min(event_id) AS first FROM events GROUP BY 1")
def win04_first_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))


@query("SELECT artist, (floor((row_number() OVER (ORDER BY artist) - 1) / 20) + 1)::BIGINT AS page FROM (SELECT DISTINCT p_name AS artist FROM part)")
def win05_report_pages(spark, d):
    return quality.report_pages(table(spark, d, "part").select(F.col("p_name").alias("artist")))


@query("""SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER () AS n FROM part)
WHERE r <= greatest(20, ceil(0.15 * n))""")
def win06_top15pct(spark, d):
    return browse.top_share(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey")


@query("""WITH a AS (SELECT p_partkey AS id, round(p_size / 50.0, 9) AS score FROM part),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM a),
c AS (SELECT *, sum(score * score) OVER (ORDER BY r) AS c, sum(score * score) OVER () AS t FROM b WHERE r <= greatest(20, ceil(0.15 * n)))
SELECT id FROM c WHERE c >= 0.4321 * t ORDER BY r LIMIT 1""")
def win07_weighted_pick(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"))
    return explore.weighted_pick(rows, "id", 0.4321).select("id")


@query("""SELECT conv_id, turn, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS next_turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def win08_next_wrap(spark, d):
    return browse.next_in_queue(table(spark, d, "conversations").select("conv_id", "turn").distinct(), ["conv_id"], [F.asc("turn")], "turn")


@query("""SELECT event_id, CASE WHEN value > 3 THEN event_id ELSE coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), event_id) END AS previous_event_id FROM events""")
def win09_previous(spark, d):
    e = table(spark, d, "events")
    return browse.previous_or_restart(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_id", "value").select("event_id", "previous_event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def win10_history50(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    return browse.first_per_group(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


_HITS = """SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders"""


@query(f"SELECT o_custkey, min(rank) AS rank FROM ({_HITS}) WHERE o_totalprice >= 100000 GROUP BY 1")
def win11_first_passing(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    hits = table(spark, d, "orders").select("o_custkey", "o_totalprice", rank.alias("rank"))
    return hits.where("o_totalprice >= 100000").groupBy("o_custkey").agg(F.min("rank").cast("long").alias("rank"))


@query("""SELECT c_custkey AS artist_id, CASE WHEN c_nationkey % 5 = 0 THEN c_custkey ELSE first_value(c_custkey) OVER (PARTITION BY CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END ORDER BY c_name, c_custkey) END AS primary_id FROM customer""")
def win12_relink(spark, d):
    mbid = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("slug"), mbid.alias("mbid"))
    return matching.relink(rows).select("artist_id", "primary_id")

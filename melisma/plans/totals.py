"""AGG-*: totals, counts and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import dates, strings
from melisma.operators import browse, changes
from melisma.plans.registry import query, table


@query("SELECT o_orderkey, coalesce(s, 0) AS total_duration, coalesce(f, 0) AS total_size FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity)::BIGINT AS s, sum(l_linenumber)::BIGINT AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def agg01_release_totals(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(0).cast("long").alias("total_duration"), F.lit(0).cast("long").alias("total_size"))
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return changes.update_totals(o, li, "o_orderkey", {"total_duration": F.sum("l_quantity").cast("long"), "total_size": F.sum("l_linenumber").cast("long")})


@query("""SELECT c_custkey, coalesce(n, 0) AS total_tracks, round(coalesce(s, 0), 2) AS total_size FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""")
def agg02_artist_totals(spark, d):
    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    t = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"))
    return c.join(t, c.c_custkey == t.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("total_tracks"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total_size"))


@query("""SELECT (SELECT count(*) FROM customer) AS artists, (SELECT count(*) FROM lineitem) AS tracks, (SELECT count(*) FROM orders) AS releases, (SELECT count(*) FROM nation) AS genres,
(SELECT count(*) FROM customer WHERE c_acctbal > 0) AS with_art, (SELECT sum(l_quantity)::BIGINT FROM lineitem) AS playtime""")
def agg03_statistics(spark, d):
    """One row of counts; each branch is one row, joined side by side."""
    one = lambda t, *aggs: table(spark, d, t).agg(*aggs)
    parts = [one("customer", F.count("*").alias("artists"), F.count_if(F.col("c_acctbal") > 0).alias("with_art")), one("lineitem", F.count("*").alias("tracks"), F.sum("l_quantity").cast("long").alias("playtime")), one("orders", F.count("*").alias("releases")), one("nation", F.count("*").alias("genres"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS synced, (SELECT count(*) FROM part) AS reference_releases, (SELECT count(DISTINCT n_regionkey) FROM nation) AS genres")
def agg04_sync_statistics(spark, d):
    a = table(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") >= 0).alias("synced"))
    b = table(spark, d, "part").agg(F.count("*").alias("reference_releases"))
    return a.crossJoin(b).crossJoin(table(spark, d, "nation").agg(F.count_distinct("n_regionkey").alias("genres")))


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1990 AND year(o_orderdate) < 2000 GROUP BY 1 ORDER BY 1")
def agg05_years_in_decade(spark, d):
    y = F.year("o_orderdate").cast("long")
    return table(spark, d, "orders").where(browse.in_dates(F.col("o_orderdate"), 1990)).select(y.alias("year")).groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


@query("SELECT (floor(year(o_orderdate) / 10) * 10)::BIGINT AS decade, count(*) AS n FROM orders WHERE year(o_orderdate) <> 0 GROUP BY 1 ORDER BY 1 DESC")
def agg06_decades(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").where(y != 0).select(dates.decade(y).alias("decade")).groupBy("decade").agg(F.count("*").alias("n")).orderBy(F.desc("decade"))


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1 ORDER BY 2 DESC, 1")
def agg07_genre_counts(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer").where("c_acctbal > 9000")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name").agg(F.count("c_custkey").alias("n")).orderBy(F.desc("n"), "n_name")


@query("SELECT count(*) AS total FROM orders WHERE year(o_orderdate) >= 1990 AND year(o_orderdate) < 2000")
def agg08_total(spark, d):
    return table(spark, d, "orders").where(browse.in_dates(F.col("o_orderdate"), 1990)).agg(F.count("*").alias("total"))


@query("SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1 ORDER BY 3")
def agg09_facets(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen")).orderBy("first_seen")


@query("SELECT c_custkey AS conv_id, coalesce(max(turn) + 1, 0)::BIGINT AS next_position FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY 1")
def agg10_next_position(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"))
    return changes.next_position(table(spark, d, "conversations"), parents, "conv_id", "turn")


@query("SELECT split_part(url, '/', 3) AS host, count(*) AS files, sum(length(html))::BIGINT AS size, array_to_string(list_sort(list_distinct(list(page_id % 3))), ',') AS keys FROM pages GROUP BY 1")
def agg11_partial_final(spark, d):
    g = table(spark, d, "pages").groupBy(F.get(F.split("url", "/"), F.lit(2)).alias("host"))
    return g.agg(F.count("*").alias("files"), F.sum(F.length("html")).cast("long").alias("size"), F.array_join(F.sort_array(F.collect_set(F.col("page_id") % 3)), ",").alias("keys"))


@query("SELECT upper(string_split(url, '.')[-1]) AS ext, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1")
def agg12_extensions(spark, d):
    return table(spark, d, "pages").groupBy(F.upper(strings.extension(F.col("url"))).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


@query("SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM pages GROUP BY 1")
def agg13_folders(spark, d):
    return table(spark, d, "pages").groupBy(strings.parent_folder(F.col("url")).alias("folder")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (p_size < 10) AS small, count(*) FILTER (p_retailprice > 1500) AS dear, count(*) FILTER (p_brand = 'Brand#11') AS brand FROM part")
def agg14_conditional(spark, d):
    return table(spark, d, "part").agg(F.count_if(F.col("p_size") < 10).alias("small"), F.count_if(F.col("p_retailprice") > 1500).alias("dear"), F.count_if(F.col("p_brand") == "Brand#11").alias("brand"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def agg15_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS names FROM nation GROUP BY 1")
def agg16_sorted_lists(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT source, count(*) AS files, count(*) FILTER (n_chars > 1000) AS matched FROM documents GROUP BY 1")
def agg17_group_totals(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 1000).alias("matched"))


@query("SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM pages WHERE length(html) < 2000 GROUP BY 1")
def agg18_issue_folders(spark, d):
    return table(spark, d, "pages").where(F.length("html") < 2000).groupBy(strings.parent_folder(F.col("url")).alias("folder")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 4) AS average FROM customer GROUP BY 1")
def agg19_mean_score(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 4).alias("average"))


@query("SELECT source, min(doc_id) AS first_seen, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2")
def agg20_stable_groups(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n")).orderBy("first_seen")


@query("SELECT coalesce(nullif(year(o_orderdate), 1996), 0) AS year, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def agg21_by_year(spark, d):
    year = F.coalesce(F.nullif(F.year("o_orderdate").cast("long"), F.lit(1996).cast("long")), F.lit(0).cast("long"))
    return table(spark, d, "orders").groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def agg22_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey").distinct()

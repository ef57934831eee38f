"""JN-*, SET-*, QRY-*: joins, set operations and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import strings
from melisma.operators import browse, catalogue, quality
from melisma.plans.registry import query, table


@query("SELECT o_custkey, count(*) AS tracks, sum(l_quantity)::BIGINT AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def jn01_inner_for_totals(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count("*").alias("tracks"), F.sum("l_quantity").cast("long").alias("seconds"))


@query("""SELECT o_custkey, min(l_partkey) AS sample FROM (SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS r
FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r = 1 GROUP BY 1""")
def jn02_sample_row(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", F.col("l_partkey").alias("sample"))
    return browse.first_per_group(rows, ["o_custkey"], [F.asc("sample")])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn03_required_include(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("""SELECT l_orderkey, l_partkey, count(*) AS n, min(p_brand) AS brand, min(s_name) AS supplier FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 20
LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY 1, 2""")
def jn04_optional_includes(spark, d):
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size < 20"), table(spark, d, "supplier").where("s_acctbal > 0")
    rows = li.join(p, li.l_partkey == p.p_partkey, "left").join(s, li.l_suppkey == s.s_suppkey, "left")
    return rows.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.min("p_brand").alias("brand"), F.min("s_name").alias("supplier"))


@query("""SELECT c_custkey, n_name, array_to_string(coalesce(r, []), ',') AS releases FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def jn05_to_many(spark, d):
    c, n, o = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "orders")
    lists = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("r"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(lists, c.c_custkey == lists.o_custkey, "left")
    return rows.select("c_custkey", "n_name", F.coalesce(F.array_join("r", ","), F.lit("")).alias("releases"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def jn06_semi_genre(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").where("n_regionkey = 2")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def jn07_in_list(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_suppkey = 7").select("l_orderkey").distinct()
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("""SELECT p_partkey, coalesce(l.k, -1) AS local_id FROM part LEFT JOIN (SELECT l_partkey, max(l_orderkey) AS k FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON l_partkey = p_partkey""")
def jn08_last_wins(spark, d):
    p = table(spark, d, "part")
    last = browse.last_wins(table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey", "l_orderkey"), "l_partkey", "l_orderkey")
    return p.join(last, p.p_partkey == last.l_partkey, "left").select("p_partkey", F.coalesce("l_orderkey", F.lit(-1)).cast("long").alias("local_id"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def jn09_anti(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT a.page_id, b.page_id IS NULL AS is_new FROM pages a LEFT JOIN (SELECT * FROM pages WHERE page_id % 4 <> 0) b ON a.url = b.url AND a.page_id = b.page_id")
def jn10_change_join(spark, d):
    a = table(spark, d, "pages").select("page_id", "url")
    b = a.where("page_id % 4 <> 0").withColumn("known", F.lit(True))
    return a.join(b, ["page_id", "url"], "left").select("page_id", F.col("known").isNull().alias("is_new"))


@query("SELECT page_id, count(*) OVER (PARTITION BY regexp_extract(url, '^(.*)/[^/]*$', 1)) = 1 AS lone FROM pages")
def jn11_lone_files(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return quality.lone_files(rows).select("page_id", "lone")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def jn12_status_tracks(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS favourite FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def jn13_favourite_flag(spark, d):
    docs, f = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("f", F.lit(True))
    return docs.join(f, "doc_id", "left").select("doc_id", F.col("f").isNotNull().alias("favourite"))


@query("""SELECT a.p_partkey, coalesce(min(b.p_partkey), -1) AS local_id FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND lower(a.p_name) = lower(b.p_name) AND b.p_partkey % 2 = 0 GROUP BY 1""")
def jn14_title_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.lower("p_name").alias("k"))
    local = p.where("p_partkey % 2 = 0").groupBy("p_brand", "k").agg(F.min("p_partkey").alias("local_id"))
    return p.join(local, ["p_brand", "k"], "left").select("p_partkey", F.coalesce("local_id", F.lit(-1)).cast("long").alias("local_id"))


@query("""SELECT conv_id, turn, role, c_name, n_name FROM conversations JOIN customer ON c_custkey = conv_id + 1 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def jn16_four_levels(spark, d):
    t, c, n, r = table(spark, d, "conversations"), table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    rows = t.join(c, c.c_custkey == t.conv_id + 1).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select("conv_id", "turn", "role", "c_name", "n_name")


@query("""SELECT a.doc_id, a.quality AS was, b.quality AS now FROM labels a JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS quality FROM labels) b USING (doc_id) WHERE a.quality <> b.quality""")
def jn17_before_after(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").alias("was"))
    b = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("quality")).alias("now"))
    return a.join(b, "doc_id").where("was <> now").select("doc_id", "was", "now")


@query("""SELECT k.id, coalesce(o.first, k.id) AS release_id FROM (SELECT unnest([1, 2, 3, 7, 999999999])::BIGINT AS id) k LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1) o ON o_custkey = k.id""")
def jn18_two_step_id(spark, d):
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3, 7, 999999999)])).alias("id"))
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    return ids.join(first, ids.id == first.o_custkey, "left").select("id", F.coalesce("first", "id").alias("release_id"))


def _catalogue(spark, d) -> dict:
    """The tables of a catalogue: suppliers as artists, orders as releases, even ones as references, their lines as tracks."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    artist = (k % 10 + 1).cast("long")
    return {
        "artists": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("average_match_score")),
        "reference": o.where(k % 2 == 0).select(k.alias("id"), artist.alias("artist_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.lit("Album").alias("type"), F.col("o_orderstatus").alias("status")),
        "local": o.select(k.alias("id"), artist.alias("artist_id"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("title"), F.year("o_orderdate").alias("year"), F.when(k % 3 == 0, k - k % 2).alias("release_id"), F.col("o_orderstatus").alias("match_status"), F.col("o_orderdate").alias("created_at"), F.when(k % 7 == 0, F.col("o_orderdate")).alias("last_played_at")),
        "tracks": table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("n")).select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Track "), F.col("n").cast("string")).alias("title"), F.col("l_orderkey").alias("local_release_id")),
        "track_artists": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("artist_id")),
    }


_CATALOGUE = """artists AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS score FROM supplier),
reference AS (SELECT o_orderkey AS id, o_orderkey % 10 + 1 AS artist_id, o_orderpriority AS title, year(o_orderdate) AS year, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0),
local_ AS (SELECT o_orderkey AS id, o_orderkey % 10 + 1 AS artist_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS title, year(o_orderdate) AS year, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 2 END AS release_id, o_orderstatus AS match_status, o_orderdate AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS last_played_at FROM orders),
tracks AS (SELECT l_orderkey AS id, 'Track ' || min(l_partkey) AS title FROM lineitem GROUP BY 1),
mine AS (SELECT DISTINCT t.l_suppkey AS artist, l.* EXCLUDE (artist_id) FROM lineitem t JOIN local_ l ON l.id = t.l_orderkey WHERE t.l_suppkey <= 5)"""


@query(f"""WITH {_CATALOGUE},
own AS (SELECT artist, release_id AS ref, arg_max(id, (year, coalesce(title, ''), id)) AS own FROM mine WHERE release_id IS NOT NULL GROUP BY 1, 2),
linked AS (SELECT release_id AS ref, min(id) AS linked FROM local_ WHERE release_id IS NOT NULL GROUP BY 1),
listed AS (SELECT r.artist_id, r.id, r.title, r.year, 'Album' AS type, r.status, coalesce(own.own, linked.linked) AS local_release_id FROM reference r LEFT JOIN own ON own.artist = r.artist_id AND own.ref = r.id LEFT JOIN linked ON linked.ref = r.id WHERE r.artist_id <= 5),
rest AS (SELECT * FROM mine WHERE NOT EXISTS (SELECT 1 FROM listed WHERE listed.artist_id = mine.artist AND listed.local_release_id = mine.id))
SELECT * FROM listed UNION ALL SELECT artist, id, title, year, 'Unmatched', match_status, id FROM rest WHERE release_id IS NULL
UNION ALL SELECT artist, id, title, year, 'Appears On', match_status, id FROM rest WHERE release_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reference r WHERE r.artist_id = rest.artist AND r.id = rest.release_id)""")
def qry01_unified_releases(spark, d):
    """The release lists of five artists: references, unmatched releases and those that they appear on (SET-01)."""
    t = _catalogue(spark, d)
    return catalogue.artist_releases(t["artists"].where("id <= 5"), t["reference"], t["local"], t["tracks"], t["track_artists"])


@query(f"""WITH {_CATALOGUE}
(SELECT 'artist' AS kind, id, name AS label FROM artists WHERE contains(lower(name), 'r1') OR contains(lower(name), '00') ORDER BY score DESC NULLS FIRST, name, id LIMIT 5)
UNION ALL (SELECT 'release', l.id, coalesce(nullif(l.title, ''), r.title, 'Unknown Release') FROM local_ l LEFT JOIN reference r ON r.id = l.release_id WHERE coalesce(contains(lower(l.title), '00'), false) OR coalesce(contains(lower(r.title), '00'), false) ORDER BY l.created_at DESC, l.id LIMIT 5)
UNION ALL (SELECT 'track', id, title FROM tracks WHERE contains(lower(title), '00') ORDER BY title, id LIMIT 5)""".replace("contains(lower(name), 'r1') OR ", ""))
def qry02_search_union(spark, d):
    t = _catalogue(spark, d)
    return catalogue.search("00", t["artists"], t["local"], t["reference"], t["tracks"])


@query(f"""WITH {_CATALOGUE}, linked AS (SELECT release_id, min(id) AS local_id FROM local_ WHERE release_id IS NOT NULL GROUP BY 1)
SELECT 'release' AS kind, r.id, r.title, coalesce(local_id, r.id) AS shown_id FROM reference r JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) f ON f.doc_id = r.id LEFT JOIN linked ON linked.release_id = r.id
UNION ALL SELECT 'track', t.id, t.title, t.id FROM tracks t JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) f ON f.doc_id = t.id""")
def qry03_favourites(spark, d):
    t, f = _catalogue(spark, d), table(spark, d, "labels")
    liked = lambda test, name: f.where(test).select(F.col("doc_id").alias(name)).distinct().withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return catalogue.favourites(liked("quality = 1", "release_id"), liked("toxic = 1", "track_id"), t["reference"], t["local"], t["tracks"]).select("kind", "id", "title", "shown_id")


@query(f"""WITH {_CATALOGUE}, p AS (SELECT DISTINCT conv_id AS id, 'list ' || conv_id AS name FROM conversations)
SELECT 'latest' AS part, id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM local_ QUALIFY place <= 12
UNION ALL SELECT 'played', id, row_number() OVER (ORDER BY last_played_at DESC, id) AS place FROM local_ WHERE last_played_at IS NOT NULL QUALIFY place <= 12
UNION ALL SELECT 'playlists', id, row_number() OVER (ORDER BY name, id) AS place FROM p QUALIFY place <= 12
UNION ALL SELECT 'favourites', id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM local_ WHERE id % 11 = 0 QUALIFY place <= 12""")
def qry04_home_page(spark, d):
    t, p = _catalogue(spark, d), table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return catalogue.home(t["local"], p.withColumn("name", F.concat(F.lit("list "), F.col("id").cast("string"))), t["local"].where("id % 11 = 0").select("id", "created_at"))


@query(f"""WITH {_CATALOGUE} SELECT l.id, l.title, l.year, a.name AS artist FROM local_ l JOIN artists a ON a.id = l.artist_id WHERE l.year >= 1990 AND l.year < 2000 ORDER BY l.year, l.title NULLS FIRST, l.id LIMIT 48 OFFSET 48""")
def qry05_timeline(spark, d):
    t = _catalogue(spark, d)
    return catalogue.timeline(t["local"], t["artists"], 1990, 2)


_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT doc_id, {_NORM} AS t FROM documents), b AS (SELECT {_NORM} AS t FROM benchmark)
SELECT 'missing' AS side, count(*) AS n FROM b WHERE t NOT IN (SELECT t FROM a) UNION ALL SELECT 'extra', count(*) FROM a WHERE t NOT IN (SELECT t FROM b)""")
def set02_missing_extra(spark, d):
    title = strings.normalise_title(F.col("text")).alias("t")
    a, b = table(spark, d, "documents").select(title), table(spark, d, "benchmark").select(title)
    n = lambda df, side: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(b.join(a, "t", "left_anti"), "missing").unionByName(n(a.join(b, "t", "left_anti"), "extra"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set03_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct().orderBy("name")


@query("SELECT DISTINCT url FROM (SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url FROM pages WHERE page_id % 3 = 0)")
def set05_unreadable(spark, d):
    p = table(spark, d, "pages")
    return p.where("page_id % 2 = 0").select("url").union(p.where("page_id % 3 = 0").select("url")).distinct().orderBy("url")


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderstatus), list(left(o_orderpriority, 1))))), ',') AS merged FROM orders GROUP BY 1""")
def set06_merged_lists(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("a"), F.collect_list(F.substring("o_orderpriority", 1, 1)).alias("b"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_distinct(F.concat("a", "b"))), ",").alias("merged"))

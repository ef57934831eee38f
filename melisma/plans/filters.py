"""FLT-*, PRJ-*, SRT-*: predicates, projections, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import dates, maths, strings
from melisma.operators import browse, changes, explore, matching
from melisma.plans.registry import query, table
from melisma.sources import files


@query("SELECT c_custkey, c_name FROM customer")
def flt01_projection(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def flt02_contains(spark, d):
    return table(spark, d, "part").where(browse.contains_text(F.col("p_name"), "AN")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')")
def flt03_prefix(spark, d):
    return table(spark, d, "customer").where(F.lower("c_name").startswith("Customer#00000001".lower())).select("c_custkey")


@query("""SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(c_name), '1') AND c_acctbal / 10000 >= 0.1 AND c_acctbal / 10000 <= 0.8 AND n_regionkey IN (1, 2)
ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 48""")
def flt04_artist_browse(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n.where(F.col("n_regionkey").isin(1, 2)), c.c_nationkey == n.n_nationkey)
    keep = browse.all_of(browse.contains_text(F.col("c_name"), "1"), browse.score_between(F.col("c_acctbal") / 10000, 10, 80), None)
    order = [F.desc_nulls_first("c_acctbal"), F.asc("c_custkey")]
    return browse.page(rows.where(keep), order, 1, 48).select("c_custkey", "c_name", "c_acctbal", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal / 10000 >= 0.25 AND c_acctbal / 10000 <= 0.75")
def flt05_score_range(spark, d):
    return table(spark, d, "customer").where(browse.score_between(F.col("c_acctbal") / 10000, 25, 75)).select("c_custkey")


@query("""SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 9000
WHERE coalesce(contains(lower(o_orderpriority), 'urgent'), false) OR coalesce(contains(c_name, '7'), false)""")
def flt06_or_across_tables(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 9000")
    both = o.join(c, o.o_custkey == c.c_custkey, "left")
    return both.where(browse.nullsafe_any(browse.contains_text(F.col("o_orderpriority"), "urgent"), F.contains("c_name", F.lit("7")))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1990 AND year(o_orderdate) < 2000")
def flt07_period(spark, d):
    return table(spark, d, "orders").where(browse.in_period(F.year("o_orderdate"), 1990)).select("o_orderkey")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) IS NULL OR nullif(l_linenumber, 3) BETWEEN 5 AND 9 GROUP BY 1""")
def flt08_range_or_null(spark, d):
    n = F.nullif(F.col("l_linenumber"), F.lit(3))
    return table(spark, d, "lineitem").where(n.isNull() | n.between(5, 9)).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size NOT IN (1, 2, 3)")
def flt09_excluded(spark, d):
    return table(spark, d, "part").where(~F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33") & ~F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@query("""WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, count(l_orderkey) AS plays FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey AS id FROM t WHERE (y IS NULL OR y BETWEEN 1990 AND 2014) AND plays = 0""")
def flt10_unplayed(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    plays = o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.count("l_orderkey").alias("play_count"))
    return explore.candidates(plays, 4, 9).select("id")


@query("SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NOT NULL")
def flt11_not_null(spark, d):
    return table(spark, d, "events").where(F.nullif("event_type", F.lit("click")).isNotNull()).select("event_id")


@query("SELECT doc_id FROM documents WHERE lang IS NULL OR lang = '' OR text IS NULL OR text = ''")
def flt12_null_or_empty(spark, d):
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return table(spark, d, "documents").where(empty("lang") | empty("text")).select("doc_id")


@query("""SELECT p_partkey FROM part WHERE lower(p_name) >= 'b' AND lower(p_name) <= 'g' || chr(1114111)""")
def flt13_range(spark, d):
    return table(spark, d, "part").where(browse.name_range(F.col("p_name"), None, "b", "g")).select("p_partkey")


@query("""WITH l AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1)
SELECT c_custkey FROM customer LEFT JOIN l ON user_id = c_custkey
WHERE c_acctbal < 0 OR t IS NULL OR t < TIMESTAMP '2024-02-15' - INTERVAL 20 DAYS""")
def flt14_stale(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    c = table(spark, d, "customer")
    now = F.lit("2024-02-15").cast("timestamp")
    return c.join(last, c.c_custkey == last.user_id, "left").where((F.col("c_acctbal") < 0) | dates.stale(F.col("t"), now, 20)).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE lower(s_name) BETWEEN 'supplier#000000002' AND 'supplier#000000004' || chr(1114111)")
def flt15_slug_range(spark, d):
    return table(spark, d, "supplier").where(browse.name_range(F.col("s_name"), None, "Supplier#000000002", "Supplier#000000004")).select("s_suppkey")


@query("SELECT conv_id, turn FROM conversations WHERE lower(role) NOT IN ('various artists', 'various', 'va')")
def flt16_not_various(spark, d):
    return table(spark, d, "conversations").where(~matching.is_various(F.col("role"))).select("conv_id", "turn")


@query("""SELECT p_partkey FROM part WHERE NOT (lower(split_part(p_type, ' ', 1)) IN ('single', 'bootleg', 'demo', 'interview', 'broadcast')
OR len(list_intersect(list_transform(string_split(p_type, ' '), lambda x: lower(x)), ['single', 'bootleg', 'demo', 'interview', 'broadcast'])) > 0)""")
def flt17_types(spark, d):
    return table(spark, d, "part").where(~browse.skipped_type(F.substring_index("p_type", " ", 1), F.split("p_type", " "))).select("p_partkey")


@query(r"""WITH n AS (SELECT doc_id, text AS name FROM documents)
SELECT doc_id FROM n WHERE regexp_matches(name, '(?i)//|\\|\||;|/| feat\.? | ft\.? | featuring |\(feat|\(ft') OR regexp_matches(name, ',[^ 0-9]')""")
def flt18_compound(spark, d):
    return table(spark, d, "documents").where(matching.compound_name(F.col("text"))).select("doc_id")


@query("SELECT 'index' AS source, 'no artist for ' || o_orderkey AS message FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 20 WHERE c_custkey IS NULL")
def flt19_rejects(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_nationkey < 20")
    both = o.join(c, o.o_custkey == c.c_custkey, "left")
    return changes.rejects(both, F.col("c_custkey").isNull(), "index", F.concat(F.lit("no artist for "), F.col("o_orderkey").cast("string")))[1]


@query("SELECT c_custkey FROM customer WHERE lower(c_name) > 'customer#000000100'")
def flt20_resume(spark, d):
    return table(spark, d, "customer").where(F.lower("c_name") > "Customer#000000100".lower()).select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND (contains(lower(p_name), 're') OR contains(lower(p_type), 're') OR contains(lower(p_brand), 're'))""")
def flt21_facet(spark, d):
    hit = browse.nullsafe_any(*[browse.contains_text(F.col(c), "RE") for c in ("p_name", "p_type", "p_brand")])
    return table(spark, d, "part").where((F.col("p_brand") == "Brand#12") & hit).select("p_partkey")


@query("SELECT n_name FROM nation WHERE contains(lower(n_name), 'a') ORDER BY n_name LIMIT 30")
def flt22_dropdown(spark, d):
    return table(spark, d, "nation").where(browse.contains_text(F.col("n_name"), "a")).select("n_name").orderBy("n_name").limit(30)


@query("SELECT c_custkey FROM customer WHERE false")
def flt23_short_query(spark, d):
    q = "a"
    c = table(spark, d, "customer").select("c_custkey")
    return c.where(browse.contains_text(F.col("c_custkey").cast("string"), q)) if len(q) >= 2 else c.limit(0)


@query("SELECT page_id FROM pages WHERE contains(lower(url), '1') OR contains(lower(split_part(url, '/', 3)), 'a')")
def flt24_report_filter(spark, d):
    return table(spark, d, "pages").where(browse.contains_text(F.col("url"), "1") | browse.contains_text(F.get(F.split("url", "/"), F.lit(2)), "a")).select("page_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def flt25_clamped_page(spark, d):
    return browse.page(table(spark, d, "orders"), [F.asc("o_orderkey")], -3, 5000).select("o_orderkey")


@query("""WITH a AS (SELECT c_custkey, list(o_orderpriority) AS l FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, len(list_filter(l, lambda x: lower(x) IN ('1-urgent', '2-high')))::BIGINT AS known, len(list_filter(l, lambda x: lower(x) NOT IN ('1-urgent', '2-high')))::BIGINT AS other FROM a""")
def flt26_split_links(spark, d):
    links = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("type"))).alias("l"))
    known, other = browse.split_links(F.col("l"), ["1-urgent", "2-high"])
    return links.select("c_custkey", F.size(known).cast("long").alias("known"), F.size(other).cast("long").alias("other"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '12')")
def flt27_search_beats_letter(spark, d):
    letter, search = "a", "12"
    c = F.col("c_name")
    keep = browse.contains_text(c, search) if search else F.lower(c).startswith(letter)
    return table(spark, d, "customer").where(keep).select("c_custkey")


@query("SELECT conv_id, turn, coalesce(nullif(text, ''), nullif(role, ''), 'Unknown') AS title FROM conversations")
def prj01_defaults(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(browse.first_given(F.col("text"), F.col("role")), F.lit("Unknown")).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN {'id': c_custkey, 'name': c_name}::VARCHAR END IS NULL AS no_artist, c_name AS artist_name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def prj02_nested(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0")
    nested = F.when(F.col("c_custkey").isNotNull(), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("artist")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", nested).select("o_orderkey", F.col("artist").isNull().alias("no_artist"), F.col("artist.name").alias("artist_name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '/img/' || page_id END AS image FROM pages WHERE page_id % 5 <> 4 UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END FROM pages WHERE page_id % 5 = 4")
def prj03_image(spark, d):
    remote = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("")
    local = F.when(F.col("page_id") % 5 == 4, "").otherwise(F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", browse.image_url(remote, local, True, "/img/").alias("image"))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_name")
def srt01_mixed_sort(spark, d):
    return table(spark, d, "customer").orderBy(F.desc_nulls_first("c_acctbal"), F.asc("c_name")).select("c_custkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 24 OFFSET 24")
def srt02_selectable_sort(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return browse.page(c, browse.artist_order("score"), 2, 24).select("id", "name")


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem ORDER BY nullif(l_returnflag, 'N') ASC NULLS LAST, nullif(l_linenumber, 1) ASC NULLS LAST, l_shipdate ASC NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_extendedprice""")
def srt03_nullable_sort(spark, d):
    order = [F.asc_nulls_last(F.nullif(F.col("l_returnflag"), F.lit("N"))), F.asc_nulls_last(F.nullif(F.col("l_linenumber"), F.lit(1))), F.asc_nulls_last("l_shipdate"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    return table(spark, d, "lineitem").orderBy(*order).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 12")
def srt04_latest(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(12).select("o_orderkey", "c_name", "o_orderdate")


@query("SELECT c_custkey, max(ts) AS last_played FROM events JOIN customer ON c_custkey = user_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def srt04_last_played(spark, d):
    e, c = table(spark, d, "events"), table(spark, d, "customer")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_played"))
    return last.join(c, last.user_id == c.c_custkey).orderBy(F.desc("last_played"), "c_custkey").limit(12).select("c_custkey", "last_played")


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) >= 1990 AND year(o_orderdate) < 2000
ORDER BY year(o_orderdate), o_orderkey LIMIT 48 OFFSET 48""")
def srt05_timeline_page(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.where(browse.in_dates(F.col("o_orderdate"), 1990)).join(c, o.o_custkey == c.c_custkey)
    return browse.page(rows, [F.year("o_orderdate").asc(), F.asc("o_orderkey")], 2).select("o_orderkey", "c_name")


@query("SELECT url FROM pages ORDER BY url")
def srt06_path_sort(spark, d):
    return table(spark, d, "pages").select("url").orderBy("url")


@query("SELECT DISTINCT lower(p_name) AS name FROM part ORDER BY name")
def srt07_locale_sort(spark, d):
    return table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct().orderBy(F.collate("name", "UNICODE"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET (SELECT floor(0.37 * count(*))::BIGINT FROM orders)")
def srt08_random_row(spark, d):
    return browse.random_row(table(spark, d, "orders"), "o_orderkey", 0.37).select("o_orderkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || '|7'), p_partkey) AS place FROM part")
def srt09_shuffle(spark, d):
    placed = browse.running(table(spark, d, "part").select("p_partkey"), browse.seeded("p_partkey", 7))
    return placed.select("p_partkey", F.col("_place").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|3'), o_orderkey LIMIT 500")
def srt10_sample(spark, d):
    return explore.sampled(table(spark, d, "orders"), "o_orderkey", 500, 3).select("o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 25")
def srt11_limit(spark, d):
    return table(spark, d, "supplier").orderBy("s_name", "s_suppkey").limit(25).select("s_suppkey", "s_name")


@query("""WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)
SELECT n_regionkey, array_to_string(l[1:5], '|') AS shown, len(l) > 5 AS more FROM g""")
def srt12_overflow(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", F.array_join(F.slice("l", 1, 5), "|").alias("shown"), (F.size("l") > 5).alias("more"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def src05_lookup(spark, d):
    return files.by_key(table(spark, d, "customer"), c_custkey=42).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def src06_load(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events ORDER BY ts, event_id")
def src11_queue(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").select("event_id")


@query("""SELECT 'region' AS "table", count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders""")
def src15_row_counts(spark, d):
    return files.row_counts({t: table(spark, d, t) for t in ("region", "nation", "orders")} | {"none": table(spark, d, "part").limit(0)})


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 10000 >= 0.8 THEN 'high' WHEN s_acctbal / 10000 >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM supplier")
def mth03_bands(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", maths.score_band(F.col("s_acctbal") / 10000).alias("band"))


@query("SELECT o_orderkey, (floor(year(o_orderdate) / 10) * 10)::BIGINT AS decade, upper(substr(o_orderpriority, 3, 1)) AS initial FROM orders")
def dt02_decade(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.decade(F.year("o_orderdate")).alias("decade"), strings.initial(F.substring("o_orderpriority", 3, 9)).alias("initial"))

"""CDC-*, SNK-*: change detection and snapshot writes over derived old and new tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import strings
from melisma.operators import changes
from melisma.plans.registry import query, table
from melisma.sources import rest
from melisma.sources.folders import work_folder


def _scan(spark, d):
    """Orders as scanned files, and an older state of most of them."""
    k = F.col("o_orderkey")
    now = table(spark, d, "orders").select(k.alias("file_path"), (k * 10).alias("file_size"), F.col("o_orderdate").alias("mtime"), F.col("o_orderpriority").alias("content_hash"))
    p = F.col("file_path")
    old = now.where("file_path % 7 <> 0").select("file_path", F.when(p % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), F.when(p % 3 == 0, F.col("mtime") + F.expr("INTERVAL 2 SECONDS")).when(p % 3 == 1, F.col("mtime") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("mtime")).alias("mtime"), F.when(p % 2 == 0, F.col("content_hash")).otherwise("x").alias("content_hash"))
    return now, old


_ACTION = "CASE WHEN k % 7 = 0 THEN 'NEW' WHEN k % 5 <> 0 AND k % 3 <> 0 THEN 'SKIP' WHEN k % 2 = 0 THEN 'TOUCH' ELSE 'UPDATE' END"


@query(f"SELECT k AS file_path, {_ACTION} AS action FROM (SELECT o_orderkey AS k FROM orders)")
def cdc01_classify(spark, d):
    return changes.classify(*_scan(spark, d)).select("file_path", "action")


@query("SELECT 'main' AS id, max(lower(c_name)) AS cursor, count(*) AS done, 0 AS left_behind FROM customer")
def cdc02_checkpoint(spark, d):
    """Two saves, of which the second counts; another checkpoint is cleared and loads as nothing."""
    c, top = table(spark, d, "customer"), work_folder(spark)
    state = lambda rows: rows.agg(F.max(F.lower("c_name")).alias("cursor"), F.count("*").alias("done"))
    kept, cleared = changes.Checkpoint(spark, f"{top}/kept"), changes.Checkpoint(spark, f"{top}/cleared")
    for at in (kept, cleared):
        at.save(state(c.where("c_custkey % 2 = 0")))
    kept.save(state(c))
    cleared.clear()
    left = cleared.load().agg(F.count("*").alias("left_behind"))
    return kept.load().crossJoin(F.broadcast(left))


@query(f"SELECT {_ACTION} AS action, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1")
def agg23_summary(spark, d):
    return changes.run_summary(changes.classify(*_scan(spark, d)))


@query("SELECT r_name AS name FROM region UNION SELECT n_name FROM nation WHERE n_nationkey < 10")
def snk01_get_or_create(spark, d):
    have = table(spark, d, "region").select(F.col("r_name").alias("name"))
    want = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("name"))
    return changes.get_or_create(have, want.union(want), ["name"])


@query("""SELECT o_custkey AS artist, title, max(CASE WHEN new THEN y END) IS NULL AS only_old, coalesce(max(CASE WHEN new THEN y END), max(y), -1)::BIGINT AS year FROM
(SELECT o_custkey, o_orderpriority AS title, min(year(o_orderdate)) AS y, false AS new FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2
UNION ALL SELECT o_custkey, o_orderpriority, max(CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END), true FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2) GROUP BY 1, 2""")
def snk02_release_upsert(spark, d):
    o, y = table(spark, d, "orders"), F.year("o_orderdate").cast("long")
    key = [F.col("o_custkey").alias("artist"), F.col("o_orderpriority").alias("title")]
    old = o.where("o_orderkey % 2 = 0").groupBy(*key).agg(F.min(y).alias("year")).withColumn("only_old", F.lit(True))
    new = o.where("o_orderkey % 2 = 1").groupBy(*key).agg(F.max(F.when(F.col("o_orderkey") % 3 != 0, y)).alias("year"))
    new = new.withColumn("only_old", F.col("year").isNull())
    got = changes.upsert(old.select("artist", "title", "year", "only_old"), new, ["artist", "title"], fill=("year",))
    return got.withColumn("year", F.coalesce("year", F.lit(-1)).cast("long"))


@query("SELECT p_type AS slug, min(p_partkey) AS id FROM part GROUP BY 1")
def snk03_dimension(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("slug"), F.col("p_partkey").alias("id"))
    return changes.get_or_create(p.limit(0), p, ["slug"])


@query("""SELECT coalesce(a.k, b.k) AS path, coalesce(b.size, a.size)::BIGINT AS size, coalesce(a.plays, b.plays)::BIGINT AS plays FROM
(SELECT o_orderkey AS k, 1 AS size, o_custkey AS plays FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, 2 AS size, 0 AS plays FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k""")
def snk05_upsert(spark, d):
    o = table(spark, d, "orders")
    row = lambda df, size, plays: df.select(F.col("o_orderkey").alias("path"), F.lit(size).cast("long").alias("size"), plays.cast("long").alias("plays"))
    old, new = row(o.where("o_orderkey % 3 <> 0"), 1, F.col("o_custkey")), row(o.where("o_orderkey % 2 = 0"), 2, F.lit(0))
    return changes.upsert(old, new, ["path"], keep=("plays",))


@query("SELECT DISTINCT l_orderkey AS track_id, l_suppkey AS artist_id, l_returnflag AS role FROM lineitem")
def snk06_bridge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("artist_id"), F.col("l_returnflag").alias("role"))
    return changes.get_or_create(rows.where("track_id % 2 = 0").distinct(), rows, ["track_id", "artist_id", "role"])


@query("SELECT DISTINCT c_nationkey AS artist_id, c_mktsegment AS genre FROM customer")
def snk07_links(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("artist_id"), F.col("c_mktsegment").alias("genre"))
    return changes.get_or_create(rows.limit(0), rows, ["artist_id", "genre"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'old' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'KNOWN' ELSE 'NEW' END AS status FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def snk08_reference_upsert(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit("old").alias("type"), F.lit("KNOWN").alias("status"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.lit("NEW").alias("status"))
    return changes.upsert(old, new, ["id"], keep=("status",))


@query("SELECT l_orderkey AS release, l_partkey AS track FROM lineitem")
def snk09_bulk(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_partkey")).alias("x"))
    g = g.select(F.transform("x", lambda e: e["l_orderkey"]).alias("a"), F.transform("x", lambda e: e["l_partkey"]).alias("b"))
    return changes.bulk_rows(g, release="a", track="b")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 'new' FROM conversations WHERE conv_id % 3 = 0")
def snk10_replace_children(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = rows.where("conv_id % 3 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("new").alias("role")).distinct()
    return changes.replace_children(rows, new, "conv_id")


@query("""SELECT 'artist' AS kind, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'release', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def snk11_cascade(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    left = changes.delete_cascade(c, c.where("c_nationkey = 3"), "c_custkey", {"release": (o, "o_custkey")})
    n = lambda df, kind: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(left[""], "artist").unionByName(n(left["release"], "release"))


@query("SELECT 'artists/' || c_name || '.jpg' AS object_key FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 0")
def snk12_queue(spark, d):
    url = F.when(F.col("c_custkey") % 3 == 0, "https://x").when(F.col("c_custkey") % 3 == 1, "")
    old = table(spark, d, "customer").withColumn("image_url", url)
    return changes.deletion_queue(old, old.where("c_custkey % 4 <> 0"), "c_custkey", "artists", "c_name")


@query("SELECT event_id AS object_key FROM events WHERE event_id % 3 = 0")
def snk13_drain(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("object_key"))
    both = q.select("object_key", (F.col("object_key") % 3 == 1).alias("ok")).unionByName(q.select("object_key", (F.col("object_key") % 3 == 2).alias("ok")))
    return changes.drain(q, both)


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def snk14_truncate(spark, d):
    return changes.emptied({"region": table(spark, d, "region")})["region"]


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT 100000000")
def snk18_favourite(spark, d):
    have = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    add = spark.range(1).select(F.lit(100000000).cast("long").alias("doc_id"))
    return changes.get_or_create(have, add.unionByName(have.limit(3)), ["doc_id"])


@query("""SELECT slug, min(name) AS name FROM (SELECT lower(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, p_brand AS name, 0 AS new FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), name, 1 FROM (SELECT p_type AS name FROM part UNION SELECT upper(p_brand) FROM part)) WHERE new = 0 OR slug NOT IN (SELECT trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') FROM part WHERE p_partkey % 2 = 0) GROUP BY 1""")
def snk19_playlist_create(spark, d):
    p = table(spark, d, "part")
    have = p.where("p_partkey % 2 = 0").select(strings.ascii_slug(F.col("p_brand")).alias("slug"), F.col("p_brand").alias("name")).distinct()
    want = p.select(F.col("p_type").alias("name")).unionByName(p.select(F.upper("p_brand").alias("name"))).distinct()
    return changes.create_playlists(have, want)[0]


@query("SELECT 'c' || conv_id AS slug, count(*) AS entries FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1")
def snk19_playlist_delete(spark, d):
    t = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("slug"), "conv_id")
    lists = t.distinct()
    left, entries = changes.delete_playlists(lists, t, lists.where("conv_id % 3 = 0"))
    return entries.join(left.select("slug"), "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("entries"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations),
e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM t WHERE turn < 2),
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM t WHERE turn >= 2)
SELECT 'c' || conv_id AS slug, turn AS track_id, position FROM e UNION ALL
SELECT 'c' || n.conv_id, turn, coalesce(top, -1) + place FROM n LEFT JOIN (SELECT conv_id, max(position) AS top FROM e GROUP BY 1) USING (conv_id)""")
def snk19_playlist_add(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("slug"), F.col("turn").alias("track_id")).distinct()
    place = F.row_number().over(Window.partitionBy("slug").orderBy("track_id"))
    have = t.where("track_id < 2").withColumn("position", (place - 1).cast("long"))
    return changes.add_entries(have, t.withColumn("n", F.col("track_id")))


@query("SELECT conv_id, count(*) AS entries FROM conversations WHERE turn <> 1 GROUP BY 1")
def snk19_playlist_remove(spark, d):
    t = table(spark, d, "conversations")
    gone = t.where("turn = 1").select("conv_id", "turn").distinct()
    return t.join(gone, ["conv_id", "turn"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("entries"))


@query("SELECT o_orderkey, CASE WHEN p_size > 25 THEN 'COMPLETE' WHEN p_partkey IS NOT NULL THEN 'INCOMPLETE' ELSE o_orderstatus END AS status FROM orders LEFT JOIN part ON p_partkey = o_orderkey")
def snk21_status_update(spark, d):
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    status = F.when(F.col("p_size") > 25, "COMPLETE").when(F.col("p_partkey").isNotNull(), "INCOMPLETE").otherwise(F.col("o_orderstatus"))
    return o.join(p, o.o_orderkey == p.p_partkey, "left").select("o_orderkey", status.alias("status"))


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 7 ELSE n END::BIGINT AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def jn15_update_from(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit(7).cast("long").alias("total"))
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return changes.update_totals(c, o, "c_custkey", {"total": F.count("*")})


@query("SELECT event_id AS query, 0 AS rank, 'id' || event_id AS id, event_type AS name, (event_id % 100)::INTEGER AS score FROM events")
def src08_search_hits(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("id"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), (F.col("event_id") % 100).cast("int").alias("score"))).alias("artists")))
    return rest.search_hits(table(spark, d, "events").select(F.col("event_id").alias("query"), body.alias("body")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '.jpg' END AS picture, 'u' || event_id AS thumbnail FROM events")
def src09_json_paths(spark, d):
    e = table(spark, d, "events")
    claims = F.when(F.col("event_id") % 2 == 0, F.format_string('{"entities":{"Q%d":{"claims":{"P18":[{"mainsnak":{"datavalue":{"value":"%s.jpg"}}}]}}}}', "event_id", "event_type")).otherwise('{"entities":{"Q1":{"claims":{}}}}')
    thumbs = F.format_string('{"query":{"pages":{"1":{"thumbnail":{}},"%d":{"thumbnail":{"source":"u%d"}}}}}', "event_id", "event_id")
    return e.select("event_id", rest.picture_name(claims).alias("picture"), rest.thumbnail(thumbs).alias("thumbnail"))


@query("SELECT 'message' AS source, 'x' || props AS message FROM events WHERE event_id % 9 = 0")
def src14_malformed(spark, d):
    raw = table(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("value"))
    return rest.messages(raw, "k bigint")[1]

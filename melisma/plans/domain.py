"""ENT-*, EXP-*, DQ-*: names, scores and tag rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import arrays, strings
from melisma.operators import explore, matching, quality
from melisma.plans.registry import query, table
from melisma.plans.texts import _NORM


def _tag():
    """A name tag with every kind of delimiter around whole texts."""
    t, a, b = F.col("text"), F.coalesce("source", F.lit("x")), F.coalesce("lang", F.lit("x"))
    n = F.col("doc_id") % 6
    out = F.when(n == 0, F.concat(t, F.lit(" feat. "), a)).when(n == 1, F.concat(a, F.lit("/"), t, F.lit(";"), a)).when(n == 2, F.concat(t, F.lit(" (ft "), a, F.lit(")")))
    return out.when(n == 3, F.concat(a, F.lit(" // "), t, F.lit("|"), b)).when(n == 4, F.concat(t, F.lit(" & "), b)).otherwise(F.concat(F.lit("Various Artists; "), t, F.lit(" / VA")))


_TAG = """(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN t || ' feat. ' || a WHEN 1 THEN a || '/' || t || ';' || a WHEN 2 THEN t || ' (ft ' || a || ')' WHEN 3 THEN a || ' // ' || t || '|' || b WHEN 4 THEN t || ' & ' || b ELSE 'Various Artists; ' || t || ' / VA' END AS tag
FROM (SELECT doc_id, text AS t, coalesce(source, 'x') AS a, coalesce(lang, 'x') AS b FROM documents))"""
_PIECES = r"list_filter(list_transform(string_split_regex(regexp_replace({}, ',([^\s0-9])', chr(1) || '\1', 'g'), '//|\\\\|\|\||[/;\\|' || chr(1) || ']'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('various artists', 'various', 'va'))"
_DIST = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


@query(rf"""WITH t AS {_TAG},
h AS (SELECT doc_id, regexp_extract(tag, '(?is)^(.*?)(\s*\(\s*feat(?:uring)?\.?\s+|\s+feat(?:uring)?\.?\s+|\s*\(\s*ft\.?\s+|\s+ft\.?\s+)(.*)$', ['l', 'm', 'r']) AS x, tag FROM t),
p AS (SELECT doc_id, CASE WHEN x.m = '' THEN tag ELSE x.l END AS l, CASE WHEN x.m = '' THEN NULL WHEN contains(x.m, '(') THEN trim(regexp_replace(x.r, '\)+$', '')) ELSE x.r END AS r FROM h),
s AS (SELECT doc_id, {_PIECES.format('l')} AS m, coalesce({_PIECES.format('r')}, []) AS f FROM p),
u AS (SELECT doc_id, {_DIST.format('m')} AS m, {_DIST.format('f')} AS f FROM s)
SELECT doc_id, array_to_string(m, '+') AS main, array_to_string(list_filter(f, lambda x: NOT list_contains(list_transform(m, lambda y: lower(y)), lower(x))), '+') AS featured FROM u""")
def ent01_split(spark, d):
    s = matching.split_artists(_tag())
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.array_join("s.main", "+").alias("main"), F.array_join("s.featured", "+").alias("featured"))


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_type END), max(CASE WHEN event_type = 'view' THEN event_type END), 'Unknown Artist') AS artist FROM events GROUP BY 1")
def ent02_canonical(spark, d):
    pick = lambda t: F.collect_set(F.when(F.col("event_type") == t, F.col("event_type")))
    g = table(spark, d, "events").groupBy("user_id").agg(pick("purchase").alias("a"), pick("view").alias("b"))
    return g.select("user_id", matching.canonical_artist(F.col("a"), F.col("b")).alias("artist"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS track_id, l_suppkey, l_returnflag FROM lineitem),
a AS (SELECT track_id, list(DISTINCT 's' || l_suppkey) FILTER (l_returnflag = 'A') AS aa, list(DISTINCT 's' || l_suppkey) FILTER (l_returnflag = 'N') AS ta, list(DISTINCT 's' || l_suppkey) FILTER (l_returnflag = 'R') AS f FROM t GROUP BY 1),
c AS (SELECT track_id, coalesce(list_sort(aa), []) AS aa, coalesce(list_sort(ta), []) AS ta, coalesce(f, []) AS f, coalesce(list_sort(aa)[1], list_sort(ta)[1], 'Unknown Artist') AS who FROM a)
SELECT track_id, unnest(CASE WHEN len(aa) > 0 THEN aa ELSE [who] END) AS name, 'ALBUM_ARTIST' AS role FROM c
UNION ALL SELECT track_id, unnest(CASE WHEN len(ta) > 0 THEN ta ELSE [who] END), 'PRIMARY' FROM c UNION ALL SELECT track_id, unnest(f), 'FEATURED' FROM c""")
def ent03_roles(spark, d):
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    of = lambda flag: F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == flag, name)))
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("track_id")).agg(of("A").alias("album_artists"), of("N").alias("track_artists"), of("R").alias("featured"))
    return matching.roles(t)


_SIM = f"""SELECT *, {_NORM.format("regexp_replace(lower(a), '^the ', '')")} AS x, {_NORM.format("regexp_replace(lower(b), '^the ', '')")} AS y"""


@query(f"""WITH p AS ({_SIM} FROM (SELECT p_partkey, p_name AS a, 'the ' || p_name || ' ' || p_type AS b FROM part)),
w AS (SELECT p_partkey, x, y, list_filter(string_split(x, ' '), lambda s: s <> '') AS wx, list_filter(string_split(y, ' '), lambda s: s <> '') AS wy FROM p)
SELECT p_partkey, x = y OR (len(wx) <> 1 AND len(wy) <> 1 AND (len(list_distinct(list_concat(wx, wy))) = 0 OR len(list_intersect(list_distinct(wx), list_distinct(wy))) / len(list_distinct(list_concat(wx, wy))) >= 0.5)) AS similar FROM w""")
def ent04_jaccard(spark, d):
    other = F.concat(F.lit("the "), "p_name", F.lit(" "), "p_type")
    return table(spark, d, "part").select("p_partkey", matching.similar_names(F.col("p_name"), other).alias("similar"))


@query("""WITH h AS (SELECT p_brand AS q, p_partkey AS id, p_name AS name, p_size * 2 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS query FROM part)
SELECT q, arg_min(id, rank) AS id FROM h WHERE score >= 90 AND lower(name) = lower(query) GROUP BY 1""")
def ent05_acceptance(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand")
    p = table(spark, d, "part")
    hits = p.select(F.col("p_brand").alias("q"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 2).alias("score"), F.row_number().over(w.orderBy("p_partkey")).alias("rank"), F.first("p_name").over(w.orderBy(F.desc("p_partkey"))).alias("query"))
    good = matching.first_acceptable(hits.where(F.lower("name") == F.lower("query")), ["q"], "query", "name", "score", "rank")
    return good.select("q", "id")


@query("""WITH a AS (SELECT c_custkey AS artist_id, c_name AS name, c_mktsegment || ', ' || c_name || ' & x' AS raw FROM customer),
u AS (SELECT artist_id, 1 AS stage, -1 AS sep_ix, 0 AS piece_ix, name AS text FROM a
UNION ALL SELECT artist_id, 2, -1, 0, 'tag ' || name FROM a
UNION ALL SELECT artist_id, 3, 0, i - 1, trim(string_split(raw, ', ')[i]) FROM a, (SELECT unnest([1, 2]) AS i)
UNION ALL SELECT artist_id, 3, 1, i - 1, trim(string_split(raw, ' & ')[i]) FROM a, (SELECT unnest([1, 2]) AS i))
SELECT u.* FROM u JOIN a USING (artist_id) WHERE stage < 3 OR lower(text) <> lower(name)""")
def ent06_cascade(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("name"), F.concat(F.lit(" tag "), "c_name").alias("raw_artist"), F.concat("c_mktsegment", F.lit(", "), "c_name", F.lit(" & x")).alias("raw_album_artist"))
    return matching.fallback_queries(rows).select("artist_id", "stage", "sep_ix", "piece_ix", "text")


@query("""WITH r AS (SELECT o_orderkey AS ref_id, o_custkey AS artist, o_orderpriority AS title, coalesce(t, []) AS t FROM orders LEFT JOIN (SELECT l_orderkey, list('t' || l_linenumber) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0),
l AS (SELECT o_custkey AS artist, o_orderpriority AS title, min(o_orderkey) AS local_id FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
lt AS (SELECT l_orderkey AS local_id, list('t' || l_linenumber) AS t FROM lineitem GROUP BY 1),
j AS (SELECT ref_id, l.local_id, r.t AS a, coalesce(lt.t, []) AS b FROM r LEFT JOIN l USING (artist, title) LEFT JOIN lt ON lt.local_id = l.local_id),
c AS (SELECT ref_id, local_id, len(a) AS n, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS m, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS e FROM j)
SELECT ref_id, coalesce(local_id, -1) AS local_id, CASE WHEN local_id IS NULL THEN 'MISSING' WHEN m = 0 AND e = 0 THEN 'COMPLETE' WHEN m = 0 THEN 'EXTRA_TRACKS' ELSE 'INCOMPLETE' END AS status,
CASE WHEN local_id IS NULL THEN n ELSE m END::BIGINT AS missing, e::BIGINT AS extra, round(CASE WHEN local_id IS NULL THEN 0 WHEN m = 0 THEN 1 ELSE (n - m) / n END, 6) AS score FROM c""")
def ent07_status(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("T "), F.col("l_linenumber").cast("string"))).alias("tracks"))
    o = table(spark, d, "orders")
    rel = o.join(li, o.o_orderkey == li.l_orderkey, "left").select("o_orderkey", F.col("o_custkey").alias("artist_id"), F.col("o_orderpriority").alias("title"), "tracks")
    ref = rel.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "ref_id")
    local = rel.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "local_id")
    got = matching.match_status(ref, local)
    return got.select("ref_id", F.coalesce("local_id", F.lit(-1)).cast("long").alias("local_id"), "status", F.col("missing").cast("long").alias("missing"), F.col("extra").cast("long").alias("extra"), F.round("score", 6).alias("score"))


@query("""SELECT o_custkey AS artist_id, round(coalesce(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), -1), 6) AS average, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'full' WHEN count(*) FILTER (o_orderstatus = 'F') < count(*) THEN 'partial' ELSE 'failed' END AS outcome FROM orders GROUP BY 1""")
def ent08_outcome(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("artist_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"), (F.col("o_orderstatus") == "F").alias("failed"))
    return matching.artist_outcome(rows).select("artist_id", F.round(F.coalesce("average", F.lit(-1.0)), 6).alias("average"), "outcome")


@query("""WITH a AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS p FROM customer)
SELECT p AS artist_id, count(o_orderkey) AS releases FROM a LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def ent09_relinked(spark, d):
    who = matching.relink(table(spark, d, "customer").select(F.col("c_custkey").alias("artist_id"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("slug"), F.col("c_nationkey").alias("mbid")))
    o = table(spark, d, "orders")
    return who.join(o, who.artist_id == o.o_custkey, "left").groupBy(F.col("primary_id").alias("artist_id")).agg(F.count("o_orderkey").alias("releases"))


def _tracks(spark, d):
    """Parts as tracks: a genre tag, a year, plays, and tags for some."""
    n = F.col("p_partkey")
    genre = F.element_at(F.array(*[F.lit(g) for g in ("Downtempo, Instrumental Hip-Hop", "Symphonic Black Metal / Industrial/Electronic Metal", "Polka", "Rock", "synthpop / dream pop")]), (n % 5 + 1).cast("int"))
    meta = F.when(n % 3 == 0, F.create_map(F.lit("IntegerBpm"), (60 + n % 120).cast("string"), F.lit("MOOD_HAPPY"), (n % 100).cast("string"), F.lit("MOOD_ACOUSTIC"), (n % 90).cast("string"), F.lit("MOOD_ELECTRONIC"), F.lit("40"))).otherwise(F.create_map(F.lit("X"), F.lit("1")))
    return table(spark, d, "part").select(n.cast("string").alias("id"), genre.alias("genre"), F.when(n % 7 != 0, F.lit(1960) + n % 65).alias("year"), (n % 30).alias("play_count"), meta.alias("metadata"))


_E = "CASE n % 5 WHEN 0 THEN 37.5 WHEN 1 THEN 82.5 WHEN 3 THEN 55 WHEN 4 THEN 37.5 END"
_S = "CASE n % 5 WHEN 0 THEN 57.5 WHEN 1 THEN 57.5 WHEN 3 THEN 40 WHEN 4 THEN 62.5 END"


def _scored(source: str) -> str:
    """Tracks and their scores for the sliders 5, 3, 4, 6, as SQL."""
    return f"""(WITH t AS (SELECT n, n::VARCHAR AS id, n % 3 = 0 AS m, {_E}::DOUBLE AS e, {_S}::DOUBLE AS s, CASE WHEN n % 7 <> 0 THEN 1960 + n % 65 END AS y, n % 30 AS p FROM {source}),
a AS (SELECT *, CASE WHEN e IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(e - 500.0 / 9) / 60) END AS g, CASE WHEN e IS NULL THEN 0.5 ELSE 0.75 END AS c, 60 + n % 120 AS bpm FROM t),
b AS (SELECT *, CASE WHEN bpm BETWEEN 95 AND 130 THEN 1 WHEN (CASE WHEN bpm < 95 THEN 95 - bpm ELSE bpm - 130 END) <= 15 THEN 0.5 ELSE greatest(0, 1 - (CASE WHEN bpm < 95 THEN 95 - bpm ELSE bpm - 130 END) / 50.0) END AS t1,
  ((1 - 0.70) + (1 - 0.60) + (1 - abs(n % 100 - 65) / 100.0) + (1 - 0.05)) / 4 AS t2 FROM a)
SELECT id, 0.4 * CASE WHEN m THEN t1 * 0.5 + t2 * 0.5 ELSE g * c END
 + 0.2 * CASE WHEN y IS NULL THEN 0.5 WHEN y BETWEEN 1990 AND 1999 THEN 1 WHEN least(abs(y - 1990), abs(y - 1999)) <= 5 THEN 0.6 WHEN least(abs(y - 1990), abs(y - 1999)) <= 10 THEN 0.3 ELSE 0 END
 + 0.2 * (1 - abs(4 / 9.0 - (1 - least(p / 20.0, 1))))
 + 0.2 * CASE WHEN m THEN 1 - (abs(n % 90 - 25) / 100.0 + abs(40 - 65) / 100.0) / 2 WHEN s IS NULL THEN 0.25 ELSE greatest(0, 1 - abs(s - 600.0 / 9) / 60) * 0.75 END AS score FROM b)"""


@query(f"SELECT id, round(score, 6) AS score FROM {_scored('(SELECT p_partkey AS n FROM part)')}")
def exp01_score(spark, d):
    return explore.scored(_tracks(spark, d), 5, 3, 4, 6).select("id", F.round("score", 6).alias("score"))


def _picked(u: float, without: str) -> str:
    """One draw from the sample of 500 candidates, as SQL; scores that differ by rounding alone count as equal."""
    pool = f"""(SELECT p_partkey AS n FROM part WHERE (p_partkey % 7 = 0 OR 1960 + p_partkey % 65 BETWEEN 1980 AND 2009) AND p_partkey::VARCHAR NOT IN ({without}) ORDER BY md5(p_partkey || '|1'), p_partkey::VARCHAR LIMIT 500)"""
    return f"""(WITH a AS (SELECT id, round(score, 9) AS score FROM {_scored(pool)}),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM a),
c AS (SELECT *, sum(score * score) OVER (ORDER BY r) AS c, sum(score * score) OVER () AS t FROM b WHERE r <= greatest(20, ceil(0.15 * n)))
SELECT id, score FROM c WHERE c >= {u} * t ORDER BY r LIMIT 1)"""


@query(f"SELECT p_partkey::VARCHAR AS id, coalesce({_E}, -1)::DOUBLE AS energy, coalesce({_S}, -1)::DOUBLE AS sound FROM (SELECT p_partkey, p_partkey AS n FROM part)")
def exp02_genre_lookup(spark, d):
    g = F.col("genre")
    return _tracks(spark, d).select("id", F.coalesce(explore.genre_value(g, explore.GENRE_ENERGY), F.lit(-1.0)).alias("energy"), F.coalesce(explore.genre_value(g, explore.GENRE_SOUND), F.lit(-1.0)).alias("sound"))


@query("SELECT o_orderkey, CASE WHEN y BETWEEN 2000 AND 2004 THEN 1 WHEN least(abs(y - 2000), abs(y - 2004)) <= 5 THEN 0.6 WHEN least(abs(y - 2000), abs(y - 2004)) <= 10 THEN 0.3 ELSE 0 END::DOUBLE AS score FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def exp04_era(spark, d):
    return table(spark, d, "orders").select("o_orderkey", explore.era_score(F.year("o_orderdate"), 4).alias("score"))


@query("SELECT user_id, round(1 - abs(5 / 9.0 - (1 - least(count(*) / 20.0, 1))), 6) AS score, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END::DOUBLE AS unheard FROM events GROUP BY 1")
def exp05_familiarity(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return p.select("user_id", F.round(explore.familiarity_score(F.col("n"), 5), 6).alias("score"), explore.familiarity_score(F.col("n"), 9).alias("unheard"))


@query(f"""SELECT id, round(score, 6) AS score FROM {_picked(0.5, "'3', '9'")}""")
def exp08_pick(spark, d):
    return explore.pick(_tracks(spark, d), 5, 3, 4, 6, 0.5, exclude=["3", "9"], seed=1).select("id", F.round("score", 6).alias("score"))


def _files(spark, d):
    """Documents as files with tags: a blank title here, a bad year there."""
    n = F.col("doc_id")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    tags = F.map_from_entries(F.filter(F.array(F.when(n % 2 == 0, pair("ARTIST", F.col("source"))), pair("TITLE", F.when(n % 3 == 0, " ").otherwise(F.lit("t"))), F.when(n % 5 != 4, pair("YEAR", F.when(n % 5 == 0, "abc").when(n % 5 == 1, "2030").otherwise(F.lit("1997")))), F.when(n % 7 == 0, pair("MOOD_SAD", F.lit("3")))), lambda e: e.isNotNull()))
    path = F.concat("source", F.lit("/"), F.floor(n / 3).cast("string"), F.lit("/"), n.cast("string"), F.lit(".mp3"))
    return table(spark, d, "documents").select(path.alias("path"), "doc_id", tags.alias("tags"), (n % 4 == 0).alias("has_art"), (n % 11 != 0).alias("readable"), F.col("source").alias("artist"))


@query("""SELECT doc_id, doc_id % 2 <> 0 AS missing_artist, doc_id % 3 = 0 AS missing_title, doc_id % 3 = 0 AS blank_title, doc_id % 5 = 4 AS missing_year, doc_id % 7 <> 0 AS missing_mood, doc_id % 4 <> 0 AS missing_album_art,
coalesce(CASE doc_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '2030' END, '') AS invalid_year, true AS has_mb, true AS has_issue FROM documents""")
def dq01_rules(spark, d):
    got = quality.categories(quality.rules(_files(spark, d)))
    return got.select("doc_id", "missing_artist", "missing_title", "blank_title", "missing_year", "missing_mood", "missing_album_art", F.coalesce("invalid_year", F.lit("")).alias("invalid_year"), "has_mb", "has_issue")


@query("SELECT c_custkey, CASE WHEN c_acctbal::INTEGER <= 0 OR c_acctbal::INTEGER >= 2030 THEN 'bad' ELSE 'ok' END AS year FROM customer")
def dq03_years(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(quality.invalid_year(F.rint("c_acctbal").cast("int").cast("string")).isNotNull(), "bad").otherwise("ok").alias("year"))


@query("""WITH f AS (SELECT doc_id, source || '/' || (doc_id // 3) || '/' || doc_id || '.mp3' AS path, doc_id % 11 <> 0 AS readable FROM documents)
SELECT doc_id, NOT readable AS unreadable, count(*) OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1)) = 1 AS lone FROM f""")
def dq04_lone_unreadable(spark, d):
    return quality.lone_files(_files(spark, d)).select("doc_id", (~F.col("readable")).alias("unreadable"), "lone")


@query("""SELECT category, field, count(*) AS n FROM (
SELECT 'critical' AS category, 'artist' AS field FROM documents WHERE doc_id % 2 <> 0 UNION ALL SELECT 'critical', 'title' FROM documents, (SELECT unnest([1, 2])) WHERE doc_id % 3 = 0 UNION ALL SELECT 'critical', 'year' FROM documents WHERE doc_id % 5 IN (0, 1, 4)
UNION ALL SELECT 'mb', unnest(['mb_artist_id', 'mb_track_id', 'mb_album_id']) FROM documents UNION ALL SELECT 'discogs', unnest(['discogs_artist', 'discogs_release']) FROM documents
UNION ALL SELECT 'ids', unnest(['acoustic_id', 'songkong_id', 'bandcamp', 'wikipedia_artist']) FROM documents UNION ALL SELECT 'other', unnest(['genre', 'bpm']) FROM documents
UNION ALL SELECT 'other', 'mood' FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'other', 'album_art' FROM documents WHERE doc_id % 4 <> 0) GROUP BY 1, 2""")
def dq05_drilldown(spark, d):
    return quality.issues(quality.rules(_files(spark, d))).groupBy("category", "field").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id, source || '/' || (doc_id // 3) || '/' || doc_id || '.mp3' AS path FROM documents)
SELECT path, 'missing_artist' AS flag FROM f WHERE doc_id % 2 <> 0 AND doc_id % 4 = 1""")
def dq06_diff(spark, d):
    before = quality.rules(_files(spark, d))
    fixed = F.when(F.col("doc_id") % 4 == 1, F.map_concat("tags", F.create_map(F.lit("ARTIST"), F.lit("found")))).otherwise(F.col("tags"))
    return quality.repairs(before, quality.rules(_files(spark, d).withColumn("tags", fixed)))


@query("""WITH f AS (SELECT source || '/' || (doc_id // 3) AS folder, source || '/' || (doc_id // 3) || '/' || doc_id || '.mp3' AS path, doc_id FROM documents)
SELECT path, 'no match' AS reason FROM f WHERE folder IN (SELECT folder FROM f WHERE doc_id % 10 = 0)""")
def dq07_reasons(spark, d):
    f = _files(spark, d)
    skipped = f.where("doc_id % 10 = 0").select(strings.parent_folder(F.col("path")).alias("folder"), F.lit("no match").alias("reason")).distinct()
    return quality.spread_reasons(f, skipped)


@query("""WITH f AS (SELECT doc_id, source || '/' || (doc_id // 3) || '/' || doc_id || '.mp3' AS path, doc_id % 11 <> 0 AS readable, doc_id % 2 <> 0 AS had FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1)) = 1 AS lone, had AND doc_id % 4 <> 1 AS has FROM f)
SELECT path, CASE WHEN NOT readable THEN 'unreadable' WHEN had AND NOT has THEN 'autofixed' WHEN has AND lone THEN 'needs-review' ELSE 'quarantine' END AS destination FROM g WHERE NOT readable OR had""")
def dq08_routing(spark, d):
    rows = quality.lone_files(_files(spark, d)).withColumn("had_issue", F.col("doc_id") % 2 != 0).withColumn("has_issue", (F.col("doc_id") % 2 != 0) & (F.col("doc_id") % 4 != 1))
    return quality.route(rows)


@query("SELECT page_id, regexp_replace(substr(url, 9), '^/+', '') AS path FROM pages WHERE starts_with(url, 'https://')")
def dq09_restore(spark, d):
    return table(spark, d, "pages").where(F.col("url").startswith("https://")).select("page_id", quality.restored_path(F.col("url"), "https://").alias("path"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'skipped: none' WHEN quality = 1 THEN 'matched' ELSE 'none' END AS status FROM labels")
def dq10_status(spark, d):
    return table(spark, d, "labels").select("doc_id", quality.fix_status(F.when(F.col("doc_id") % 10 == 0, "none"), F.col("quality") == 1).alias("status"))


@query("SELECT greatest(0, count(*) - count(*) FILTER (doc_id % 11 = 0) - count(*) FILTER (doc_id % 2 = 1)) AS ok FROM documents")
def dq11_overview(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").agg(quality.ok_files(F.count("*"), F.count_if(n % 11 == 0), F.count_if(n % 2 == 1)).alias("ok"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ') AS tokens FROM benchmark")
def set04_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(arrays.distinct_ignoring_case(F.split(F.lower("text"), " "))), " ").alias("tokens"))

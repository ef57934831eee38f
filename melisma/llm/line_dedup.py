"""Near-duplicate lines by an exact set-similarity join. DataFrame functions only.

A line is the set of its words. Lines with equal sets form one class, known by its first line in order of document id
and line number; a class is joined to others on its rarest words: all words are ordered by how often they occur, and two
sets with a Jaccard of at least PCT percent share a word within their prefixes in that order. Positional and length
filters thin the candidates out, and so do sketches of the sets (64 bits, 128 for large ones); the Jaccard of the rest is verified on the whole sets. A
line is removed if a line before it matches; that is, if its class began before it, or its class matches one that began
earlier.

Classes meet under each word of their prefixes. Under a word that more than MANY have there, each is first compared with
two of them only, the earliest and the one with most lines, and verified against the nearer; what that settles needs no
further comparison, so a group of n variants of a line costs about n of them. What is still open then meets all that
began earlier, dealt out by word and length.

The order of words goes by their counts over all documents in 2**SLOT_BITS slots of word hashes, a table of a fixed size;
any order gives the same result. Words are known by hashes of 57 bits, sets by 64-bit hashes.

Edge cases: null and empty texts and blank lines are left alone. A line of three words or fewer matches equal sets only,
one of four also sets of five around it. Null ids come last in order (an id of 2**63 - 1 shares their place). Rows with
the same id and text count as one document, and get the same result. Other columns are ignored, whatever their names;
`dedup_lines` carries them along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PCT = 80
SLOT_BITS = 20
#: Under a word that more classes have in their prefixes, they are compared with two of them first.
MANY = 256
#: Sets of more words have sketches of 128 bits, others of 64.
WIDE = 64
#: Documents whose lists of lines a task gathers by hashing; beyond, it sorts.
HELD = 20_000
_HASH_BITS = 57
_LAST = (1 << 63) - 1


def _mark(docs_id: Column, text: Column) -> Column:
    return F.xxhash64(text, docs_id.isNull())


def _doc(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, h: which document a row is; text."""
    key, text = C.col(id_col).cast("long"), C.col(text_col).cast("string")
    return docs.select(F.coalesce(key, F.lit(_LAST)).alias("doc"), _mark(key, text).alias("h"), text.alias("text"))


def _spaced(text: Column) -> Column:
    """The text with its other gaps made spaces, but for newlines. Most texts have none, which takes no regular expression."""
    found = F.lit(False)
    for gap in "\t\r\x0b\x0c":
        found = found | F.contains(text, F.lit(gap))
    return F.when(found, F.regexp_replace(text, r"[\t\x0B\x0C\r]", " ")).otherwise(text)


def _tokens(spaced: Column) -> Column:
    """A text cut at single spaces, which takes no regular expression; empty strings stay between double spaces."""
    return F.split(spaced, " ")


def _word_set(line: Column) -> Column:
    """The hashes of the distinct words of a line with spaces only."""
    return F.array_remove(F.array_distinct(F.transform(_tokens(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _slot(w: Column) -> Column:
    return F.shiftrightunsigned(w, 64 - SLOT_BITS).cast("int")


def _rank(n: int) -> int:
    """The rank of a word that occurs n times."""
    return min(int(math.log2(n + 1) * 1.5), 63)


def word_ranks(rows: DataFrame) -> bytes:
    """For each slot of word hashes one byte, the logarithm of its count: a table of 2**SLOT_BITS bytes for any corpus."""
    words = rows.select(F.explode(_tokens(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")))).alias("t")).select(_slot(F.xxhash64("t")).alias("slot"))
    table = bytearray(1 << SLOT_BITS)
    counts = words.groupBy("slot").count().groupBy((F.col("slot") % 64).alias("p")).agg(F.collect_list("slot").alias("slots"), F.collect_list("count").alias("counts"))
    # all slots in the map of fixed-size rows; beyond its capacity each word is looked up in two
    with C.settings(rows.sparkSession, {"spark.sql.codegen.aggregate.fastHashMap.capacityBit": SLOT_BITS + 1}):
        for part in counts.toLocalIterator():
            for slot, n in zip(part.slots, part.counts, strict=True):
                table[slot] = _rank(n)
    return bytes(table)


def _lines(rows: DataFrame) -> DataFrame:
    """doc, h, line, l: the lines of all texts, their gaps made spaces."""
    return rows.select("doc", "h", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "l"))


def _keyed(lines: DataFrame, ranks: bytes) -> DataFrame:
    """With keys: a line's words in the order of all words, rarest first."""
    table = F.lit(ranks)
    rank = lambda w: F.ascii(F.substring(table, _slot(w) + 1, 1).cast("string"))
    key = lambda w: F.shiftleft(rank(w).cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(w, 64 - _HASH_BITS))
    return lines.select("doc", "h", "line", F.sort_array(F.transform(_word_set(F.col("l")), key)).alias("keys"))


def _odd(keys: Column) -> Column:
    """A sketch of 64 bits: a bit is set where an odd number of words fall on it."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda t, k: t.bitwiseXOR(bit(k)))


def _odd_high(keys: Column) -> Column:
    """The part of the words with bit 6 in a large set's sketch, so that it makes 128 bits; 0 for others."""
    return F.when(F.size(keys) > WIDE, _odd(F.filter(keys, lambda k: k.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))


def _apart() -> Column:
    """Words that only one line has, at least: each bit that differs shows one. 128 bits where both sets are large."""
    low, high = (F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in ("low", "high"))
    wide = (F.shiftright("x.np", 32) > WIDE) & (F.shiftright("y.np", 32) > WIDE)
    return F.when(wide, F.bit_count(low.bitwiseXOR(high)) + F.bit_count(high)).otherwise(F.bit_count(low))


def _may_match(pct: int) -> Column:
    """Length filter; positional filter at the first word that two prefixes share; and the sketches."""
    at = lambda t: (F.shiftright(F.col(f"{t}.np"), 32), F.col(f"{t}.np").bitwiseAND(F.lit((1 << 32) - 1)))
    (n1, p1), (n2, p2) = at("x"), at("y")
    return (100 * F.least(n1, n2) >= pct * F.greatest(n1, n2)) & ((100 + pct) * (1 + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= pct * (n1 + n2)) & ((100 + pct) * _apart() <= (100 - pct) * (n1 + n2))


def _band(n: Column, pct: int) -> Column:
    """Sizes that can match lie in the same band or the next; bands are a little wider than that takes."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(101 / pct))).cast("int")


def classes(docs: DataFrame, ranks: bytes, id_col: str, text_col: str, pct: int) -> DataFrame:
    """cid, o (the first line: doc, line, h), m (lines), n, low, high, prefix of each class of lines. Sets too small to
    match any but an equal one have no prefix."""
    keyed = _keyed(_lines(_doc(docs, id_col, text_col)), ranks)
    n = F.size("keys")
    p = F.when(100 * n >= pct * (n + 1), n - F.floor((n * pct + 99) / 100).cast("int") + 1).otherwise(0)
    prefix = F.slice("keys", F.lit(1), p)
    rows = keyed.select(F.xxhash64("keys").alias("sig"), F.struct("doc", "line", "h").alias("o"), n.alias("n"), _odd(F.col("keys")).alias("low"), _odd_high(F.col("keys")).alias("high"), prefix.alias("prefix"))
    out = rows.groupBy("sig").agg(F.min("o").alias("o"), F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("n", "low", "high", "prefix")])
    return out.drop("sig").where("n > 0").withColumn("cid", F.monotonically_increasing_id())


def _verified(pairs: DataFrame, groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, pct: int) -> DataFrame:
    """cid, o of the later of those pairs (a, b) whose sets reach the threshold. Only the lines at stake are read again."""
    named = C.cut(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    lines = C.join_small(groups.select("cid", "o"), named, "cid", "inner", salted=False)
    wanted = C.cut(lines.groupBy("o.doc", "o.h").agg(F.collect_list(F.struct("o.line", "cid")).alias("at")).withColumn("d", F.struct("doc", "h")).select("d", "at"))
    rows = C.join_small(_doc(docs, id_col, text_col).withColumn("d", F.struct("doc", "h")), wanted, "d", "inner", salted=False)
    # a generated column, so that a text is split once and not for each of its lines
    rows = rows.select("doc", "h", "at", F.explode(F.array(F.split(_spaced(F.col("text")), "\n"))).alias("ls"))
    some = rows.select("doc", "h", F.explode(F.transform("at", lambda x: F.struct(x["cid"].alias("cid"), x["line"].alias("line"), F.get("ls", x["line"]).alias("l")))).alias("t"))
    sets = C.cut(some.select("t.cid", F.struct("doc", "t.line", "h").alias("o"), _word_set(F.col("t.l")).alias("words")).dropDuplicates(["cid"]))
    side = lambda c, i: sets.select(F.col("cid").alias(c), F.col("o").alias(f"o{i}"), F.col("words").alias(f"w{i}"))
    both = C.join_small(C.join_small(pairs, side("a", 1), "a", "inner", salted=False), side("b", 2), "b", "inner", salted=False)
    shared = F.size(F.array_intersect("w1", "w2"))
    both = both.select(F.when(F.col("o1") > F.col("o2"), F.col("a")).otherwise(F.col("b")).alias("cid"), F.greatest("o1", "o2").alias("o"), shared.alias("s"), (F.size("w1") + F.size("w2")).alias("z"))
    hits = C.cut(both.where(100 * F.col("s") >= pct * (F.col("z") - F.col("s"))).select("cid", "o").distinct())
    C.release(named, sets, wanted)
    return hits


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = PCT) -> DataFrame:
    """doc, h, line of the lines with a word that stay."""
    return _stay(docs, id_col, text_col, pct).select("doc", "h", F.explode("stay").alias("line"))


def _first_lines(docs: DataFrame, id_col: str, text_col: str, pct: int) -> tuple[DataFrame, list[DataFrame]]:
    """cid, o of all classes; and of those that match one that began earlier, in tables that may repeat a class."""
    ranks = word_ranks(_doc(docs, id_col, text_col))
    groups = C.cut(classes(docs, ranks, id_col, text_col, pct))
    posts = groups.where(F.size("prefix") > 0).select("cid", "o", "m", "n", "low", "high", F.posexplode("prefix").alias("pos", "word"))
    posts = posts.withColumn("np", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))).drop("pos")
    # a word's rank bounds its count
    seen = posts.where(F.shiftrightunsigned("word", _HASH_BITS) >= _rank(MANY))
    hot = C.cut(seen.groupBy("word").agg(F.count("*").alias("k")).where(F.col("k") > MANY).select("word"))
    # words of few classes: all pairs under them
    cold = C.join_small(posts, hot, "word", "left_anti", salted=False).select("word", "cid", "np", "low", "high")
    pairs = cold.alias("x").join(cold.alias("y"), F.expr("x.word = y.word and x.cid > y.cid") & _may_match(pct)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    # words of many: each class and the nearer of two leaders that began earlier
    shared = C.cut(C.join_small(posts, hot, "word", "left_semi", salted=False))
    lead = F.explode(F.array(F.col("first"), F.struct(*[F.col(f"large.{c}") for c in ("o", "cid", "np", "low", "high")]))).alias("y")
    leads = shared.groupBy("word").agg(F.min(F.struct("o", "cid", "np", "low", "high")).alias("first"), F.max(F.struct("m", "o", "cid", "np", "low", "high")).alias("large"))
    leads = C.cut(leads.select("word", lead).distinct())
    met = C.join_small(shared.select("word", "cid", F.struct("o", "np", "low", "high").alias("x")), leads, "word", "inner")
    met = met.where((F.col("y.o") < F.col("x.o")) & _may_match(pct))
    near = met.groupBy("cid").agg(F.min(F.struct(_apart().alias("apart"), F.col("y.cid").alias("b"))).alias("t")).select(F.col("cid").alias("a"), F.col("t.b").alias("b"))
    done = C.cut(pairs.unionByName(near).distinct())
    removed = _verified(done, groups, docs, id_col, text_col, pct)
    # what is still open against all that began earlier
    band = _band(F.col("n"), pct)
    y = shared.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("y")
    x = C.join_small(shared, removed.select("cid"), "cid", "left_anti", salted=False).withColumn("band", band).alias("x")
    more = x.join(y, F.expr("x.word = y.word and x.band = y.band and y.o < x.o") & _may_match(pct)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    more = C.cut(more.join(done, ["a", "b"], "left_anti"))
    C.release(shared, leads, hot, done)
    again = _verified(more, groups, docs, id_col, text_col, pct)
    C.release(more)
    return groups, [removed, again]


def _stay(docs: DataFrame, id_col: str, text_col: str, pct: int) -> DataFrame:
    """doc, h, stay: the numbers of the lines that stay, a row a document of which any does."""
    spark = docs.sparkSession
    with C.short_plans(spark):
        groups, removed = _first_lines(docs, id_col, text_col, pct)
        rows = groups.select("o.doc", "o.h", "o.line", F.lit(False).alias("gone"))
        for table in removed:
            rows = rows.unionByName(table.select("o.doc", "o.h", "o.line", F.lit(True).alias("gone")))
        gone = F.collect_list(F.when(F.col("gone"), F.col("line")))
        with C.settings(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": HELD}):
            # array_except leaves one of each
            stay = rows.repartition("doc", "h").groupBy("doc", "h").agg(F.array_except(F.collect_list("line"), gone).alias("stay"))
            out = C.cut(stay.where(F.size("stay") > 0))
        C.release(groups, *removed)
        return out


def _where(lines: Column, test) -> Column:
    """The numbers of the lines that pass."""
    return F.filter(F.transform(lines, lambda l, i: F.when(test(l), i)), lambda i: i.isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = PCT) -> DataFrame:
    """The rows of docs with later matches taken out of their texts; a row whose words are all gone goes with them."""
    kept = _stay(docs, id_col, text_col, pct)
    key, text = C.col(id_col).cast("long"), C.col(text_col).cast("string")
    rows = docs.select(C.row(docs).alias("row"), F.coalesce(key, F.lit(_LAST)).alias("doc"), _mark(key, text).alias("h"))
    text = F.col("row").getField(text_col).cast("string")
    rows = rows.join(kept, ["doc", "h"], "left").withColumn("lines", F.split(text, "\n"))
    blank = _where(F.col("lines"), lambda l: ~l.rlike(C.WORD))
    stay = F.sort_array(F.array_union(F.coalesce("stay", F.array().cast("array<int>")), blank))
    # null: the text is as it was; a text with words of which no line stays goes
    same = F.col("lines").isNull() | (F.size(stay) == F.size("lines"))
    out = rows.where(F.col("lines").isNull() | F.col("stay").isNotNull() | ~text.rlike(C.WORD))
    new = F.when(~same, F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")).otherwise(text)
    return out.select(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed_lines (from 0)."""
    docs = C.table(spark, sf_dir, "documents")
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    none = F.array().cast("array<int>")
    lines = F.coalesce(_where(F.split(text, "\n"), lambda l: F.ltrim(l, F.lit(" \t\x0b\x0c\r")) != ""), none)
    rows = docs.select("doc_id", F.coalesce(key, F.lit(_LAST)).alias("doc"), _mark(key, text).alias("h"), lines.alias("lines"))
    gone = F.array_except("lines", F.coalesce("stay", none))
    rows = rows.join(_stay(docs, "doc_id", "text", PCT), ["doc", "h"], "left")
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, list_sort(list_distinct(list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
e AS (SELECT * FROM l WHERE len(ws) >= 1),
c AS (SELECT ws, min(doc_id * 1000000 + line) AS o, row_number() OVER () AS c FROM e GROUP BY ws),
t AS (SELECT c, o, len(ws) AS n, unnest(ws) AS w FROM c),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT c, o, n, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS pos FROM t JOIN f USING (w)),
x AS (SELECT * FROM p WHERE pos <= n - (n * 4 + 4) // 5 + 1),
k AS (SELECT DISTINCT a.c AS a, b.c AS b FROM x a JOIN x b USING (w) WHERE b.o < a.o AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT a FROM (SELECT k.a, len(list_intersect(u.ws, v.ws)) AS s, len(u.ws) + len(v.ws) AS z
      FROM k JOIN c u ON u.c = k.a JOIN c v ON v.c = k.b) WHERE 100 * s >= 80 * (z - s)),
r AS (SELECT e.doc_id, e.line FROM e JOIN c USING (ws) WHERE e.doc_id * 1000000 + e.line > c.o OR c.c IN (SELECT a FROM m)),
g AS (SELECT doc_id, count(*) AS k, list_sort(list(line::INTEGER)) AS gone FROM r GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.k, 0)::BIGINT AS n_removed, coalesce(g.gone, []::INTEGER[]) AS removed_lines
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Every source is cut into blocks of documents by a keyed hash, and its target, in words, becomes an exact quota of block
draws: whole epochs over all its blocks, then, in a permuted order, blocks of one more epoch, the last of them in part.
A tree then shares the quotas out: each node halves its draws, and how many of each source go left is a multivariate
hypergeometric draw, so every shard is a fair sample of the mix while the quotas stay exact. A leaf holds, for each
source, a range of that source's permuted draws; ranges of different shards are disjoint. Within a shard the documents
are ordered by a keyed hash, the local shuffle.

Equal inputs give equal mixes; nothing depends on how the rows are partitioned.

Edge cases: a null text has no words, its target share is zero and a draw of it takes no words. A null source is a
source of its own, last in order. Repeated rows are drawn each on its own. Without any word no row is drawn. An empty
table gives no rows. Other columns are ignored, whatever their names; `mixed_rows` carries them along.

The per-source table and the arrays of the tree have one entry a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_DOCS = 64
SHARD_BLOCKS = 64
_CHUNK = 1024  # blocks of one step of the prefix sums
#: Multipliers of the permutation of a source's blocks; of these, one that is prime to their number is taken.
_PRIMES = (1_000_003, 998_244_353, 1_000_000_007, 1_000_000_009, 2_147_483_647)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, docs, source_size -> with ix, weight, target.

    The targets share all words by weight; what goes beyond `most` times a source's size is shared among the others,
    which in the end all get the same multiple of their weights.
    """
    ordered = sizes.withColumn("ix", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ix") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ordered.withColumn("weight", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "ix")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    marked = ranked.withColumn("level", level)
    # the first source that its level leaves under its cap sets the level of all after it
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "ix", "level"))).over(whole)["level"]
    return marked.withColumn("final", final).select("source", "docs", "source_size", "ix", "weight", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _multiplier(n):
    out = F.lit(_PRIMES[-1])
    for p in reversed(_PRIMES[:-1]):
        out = F.when(n % p != 0, F.lit(p)).otherwise(out)
    return out


def _position(seed: int):
    """Where the permutation of an epoch puts a block."""
    shift = F.pmod(F.xxhash64("ix", "epoch", F.lit(seed)), F.col("blocks"))
    return (F.col("block") * (_multiplier(F.col("blocks")) % F.col("blocks")) + shift) % F.col("blocks")


def _hypergeometric(good: str, rest: str, draws: str, u: str) -> str:
    """SQL of a hypergeometric variate by inversion: the weights within ten deviations of the mean follow from each other."""
    mean = f"(b.n * b.g / greatest(b.g + b.r, 1D))"
    sd = f"sqrt({mean} * (b.r / greatest(b.g + b.r, 1D)) * ((b.g + b.r - b.n) / greatest(b.g + b.r - 1, 1D)))"
    step = "t.w * (b.g - k) * (b.n - k) / ((k + 1D) * (b.r - b.n + k + 1D))"
    bounds = f"""transform(array(named_struct('g', cast({good} as double), 'r', cast({rest} as double), 'n', cast({draws} as double), 'u', {u})),
      b -> named_struct('g', b.g, 'r', b.r, 'n', b.n, 'u', b.u,
        'lo', cast(greatest(0D, b.n - b.r, floor({mean} - 10 * {sd} - 10)) as bigint),
        'hi', cast(least(b.n, b.g, ceil({mean} + 10 * {sd} + 10)) as bigint)))"""
    total = f"aggregate(sequence(b.lo, b.hi), named_struct('w', 1D, 'c', 0D), (t, k) -> named_struct('w', {step}, 'c', t.c + t.w), t -> t.c)"
    summed = f"transform({bounds}, b -> named_struct('g', b.g, 'r', b.r, 'n', b.n, 'lo', b.lo, 'hi', b.hi, 'at', b.u * {total}))"
    pick = f"aggregate(sequence(b.lo, b.hi), named_struct('w', 1D, 'c', 0D, 'k', b.lo), (t, k) -> named_struct('w', {step}, 'c', t.c + t.w, 'k', if(t.c < b.at, k, t.k)), t -> t.k)"
    return f"element_at(transform({summed}, b -> {pick}), 1)"


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """ix, quota -> shard, ix, start, n: 2**levels leaves, each with a range of every source's draws."""
    entry = F.struct(F.col("ix").cast("long").alias("ix"), F.lit(0).cast("long").alias("start"), F.col("quota").cast("long").alias("n"))
    nodes = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(entry)).alias("q")).where("size(q) > 0").select(F.lit(0).cast("long").alias("node"), "q")
    u = f"((xxhash64({seed}L, node, x.ix) & 4503599627370495L) + 0.5D) / 4503599627370496D"
    draw = _hypergeometric("x.n", "s.pop - x.n", "s.cap", u)
    left = f"""aggregate(q, named_struct('pop', total, 'cap', total div 2, 'd', cast(array() as array<bigint>)),
      (s, x) -> element_at(transform(array({draw}), d -> named_struct('pop', s.pop - x.n, 'cap', s.cap - d, 'd', concat(s.d, array(d)))), 1), s -> s.d)"""
    for level in range(levels):
        if level == 6:
            nodes = nodes.repartition(64, "node")
        split = nodes.withColumn("total", F.expr("aggregate(q, 0L, (t, x) -> t + x.n)")).withColumn("l", F.expr(left))
        sides = F.expr("""array(
          named_struct('node', node * 2, 'q', filter(transform(q, (x, i) -> named_struct('ix', x.ix, 'start', x.start, 'n', l[i])), x -> x.n > 0)),
          named_struct('node', node * 2 + 1, 'q', filter(transform(q, (x, i) -> named_struct('ix', x.ix, 'start', x.start + l[i], 'n', x.n - l[i])), x -> x.n > 0)))""")
        nodes = split.select(F.explode(sides).alias("c")).select("c.node", "c.q")
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", F.col("x.ix").alias("ix"), F.col("x.start").alias("start"), F.col("x.n").alias("n"))


def _prefix(blocks: DataFrame) -> DataFrame:
    """ix, pos*, need: the block at which a source's last epoch reaches its rest, and the words still needed there.

    Two steps, so that no window holds more than a source's chunks or a chunk's blocks.
    """
    chunks = blocks.withColumn("chunk", F.floor(F.col("pos") / _CHUNK)).groupBy("ix", "chunk", "rest").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("ix").orderBy("chunk"))
    at = chunks.withColumn("upto", upto).where(F.col("upto") >= F.col("rest")).groupBy("ix").agg(F.min(F.struct("chunk", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
    last = blocks.withColumn("chunk", F.floor(F.col("pos") / _CHUNK)).join(at.select("ix", "c.chunk", "c.before"), ["ix", "chunk"])
    run = F.col("before") + F.sum("words").over(Window.partitionBy("ix", "chunk").orderBy("pos"))
    return last.withColumn("upto", run).where(F.col("upto") >= F.col("rest")).groupBy("ix").agg(F.min(F.struct("pos", (F.col("rest") - F.col("upto") + F.col("words")).alias("need"))).alias("e")).select("ix", F.col("e.pos").alias("edge"), F.col("e.need").alias("need"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_rows: bool = False, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, draws (array of epoch, shard, order).

    keep_rows adds `row`, the input's row as a struct.
    """
    # a third element tells apart what the id alone may not
    base = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(C.words(F.col(text_col))).cast("long").alias("size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h")]
    everything = docs.select(*base, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []))
    sized = C.cut(docs.select(*base))
    per_source = targets(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), weights, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = C.cut(
        per_source.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    )
    keyed = lambda df: C.join_small(df.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), sources, "key", "inner").withColumn("block", F.pmod("h", "blocks")).drop("key")
    blocks = C.cut(keyed(sized).groupBy("ix", "block", "blocks", "full", "rest").agg(F.sum("size").alias("words")))
    last = blocks.where("rest > 0").withColumn("epoch", F.col("full")).withColumn("pos", _position(seed))
    edges = C.cut(_prefix(last))
    quotas = sources.join(edges, "ix", "left").select("ix", "blocks", "full", "edge", "need", (F.col("full") * F.col("blocks") + F.coalesce(F.col("edge") + 1, F.lit(0))).alias("quota"))
    quotas = C.cut(quotas)
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, total) / shard_blocks)))
    leaves = splitting_tree(quotas.select("ix", "quota"), levels, seed)
    drawn = leaves.select("ix", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    each = C.join_small(blocks.select("ix", "block"), quotas, "ix", "inner").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("pos", _position(seed))
    each = each.where((F.col("epoch") < F.col("full")) | (F.col("pos") <= F.col("edge")))
    # in the block at the edge only documents up to the words still needed count
    each = each.select("ix", "block", "epoch", (F.col("epoch") * F.col("blocks") + F.col("pos")).alias("at"), F.when((F.col("epoch") == F.col("full")) & (F.col("pos") == F.col("edge")), F.col("need")).alias("need"))
    block_draws = C.cut(each.join(drawn, ["ix", "at"]).groupBy("ix", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "need"))).alias("d")))
    middle = F.sum("size").over(Window.partitionBy("ix", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    rows = keyed(everything).withColumn("middle", middle).join(block_draws, ["ix", "block"], "left")
    draws = F.transform(
        F.filter(F.coalesce("d", F.array().cast("array<struct<epoch:bigint,shard:bigint,need:double>>")), lambda x: x["need"].isNull() | (F.col("middle") < x["need"])),
        lambda x: F.struct(x["epoch"].alias("epoch"), x["shard"].alias("shard"), F.xxhash64(F.col("h"), x["epoch"], F.lit(seed)).alias("order")),
    )
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("source_size") > 0, draws).otherwise(F.array().cast("array<struct<epoch:bigint,shard:bigint,order:bigint>>")).alias("draws"), *(["row"] if keep_rows else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row a draw, shard by shard in their shuffled order."""
    drawn = plan(docs, keep_rows=True, **options).select("row", F.explode("draws").alias("d"))
    return drawn.repartition(F.col("d.shard")).sortWithinPartitions("d.shard", "d.order").select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = plan(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))

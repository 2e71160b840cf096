"""Mixing sources to target weights, with DataFrame expressions only.

The words of each source form one stream (documents in pseudorandom order) that is packed
into blocks of ``block_words``; a block may span documents and a long document spans many
blocks.  The mix is a list of output shards of ``shard_slots`` slots.  The slots of a
shard draw their sources independently, so that its source counts are multinomial with
the target shares.  Running sums of these counts over the shards number a source's slots;
numbers at or beyond the source's quota of blocks fall out and a last shard makes up for
what was drawn too rarely, so that totals meet the quotas.  Slot ``i`` of a source takes
block ``p(i mod blocks)`` where ``p`` is a keyed swap-or-not permutation of the block
indices for the epoch ``i div blocks``, so that no block repeats before all have been used
and none is used more than ceil(quota / blocks) times.  Slots and blocks join by index.

Positions come from running sums over (source, hash prefixes), three levels deep, so that
no task holds a whole source.  Rows that are alike in id, text and source are one row with a
count until their positions are known, and are then unrolled ``COPIES`` at a time, so that no
task holds a much repeated row either.  Sources are numbered and their running sums taken by
ranges: what one task reads as a whole is a row for each range.

Defined cases: null or wordless texts have size 0 and take 0.  A null source is one source
and sorts last.  Rows that repeat an id are separate documents, also if they are alike.  A
text of any length is counted whole; it spans as many blocks as it has words for.  With no
words at all, every target and count is 0.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gritsieve.llm.common import WORD, let, materialize

#: Most repeats of a source in the mix.
MOST_EPOCHS = 3
#: Rounds of the swap-or-not permutation.
ROUNDS = 12
#: Cells of the lookup from a draw to its source, at least; four for each source where there are many.
CELLS = 1024
#: Alike rows that one row is unrolled into at a time.
COPIES = 4096
#: Rows that one task is to unroll.
TASK_ROWS = 1_000_000


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, place)``: words of each document and its pseudorandom place."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit("place"), "doc_id", "text").alias("place"))


def summed(df: DataFrame, order: list[Column], rank: str | None = None, **sums: str) -> DataFrame:
    """``df`` with the sum of a column over the rows before each, for each of ``sums``, and with its ``rank``.

    Rows go by ranges of ``order``, which no two share; sums inside a range are added to those of the ranges before.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__one", F.lit(1).cast("long")))
    sums = sums | ({rank: "__one"} if rank else {})
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    starts = ends.select("__range", *(F.coalesce(F.sum(f"__{n}").over(before(W.orderBy("__range"))), F.lit(0)).alias(f"__{n}") for n in sums))
    within = ranged.withColumns({n: F.coalesce(F.sum(c).over(before(W.partitionBy("__range").orderBy(*order))), F.lit(0)) for n, c in sums.items()})
    return within.join(starts, "__range").select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def targets(sized: DataFrame) -> DataFrame:
    """A row for each source: its number, size, weight and target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...  Raising all targets together,
    a source reaches its cap in the order of cap / weight; with sources in this order, the
    first ones that an equal share would lift above their caps stop there.
    """
    s = summed(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], rank="number")
    s = s.withColumn("weight", F.col("number") % 3 + 1).withColumn("cap", MOST_EPOCHS * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = materialize(summed(s, [F.col("ratio"), F.col("number")], capped="cap", lighter="weight"))
    words, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    s = s.withColumn("level", (F.lit(words) - F.col("capped")) / (F.lit(weights) - F.col("lighter")))
    # the level of the first source that isn't capped is the common one
    first = s.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).alias("m")).first().m
    target = F.col("cap").cast("double")
    if first is not None:
        target = F.least(target, F.lit(first.level) * F.col("weight"))
    return s.select("source", "number", "source_size", "weight", target.alias("target"))


def quotas(goal: DataFrame, block_words: int) -> DataFrame:
    """``goal`` with each source's number of blocks, its quota of slots and the quotas up to it."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"), MOST_EPOCHS * F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    out = summed(goal.withColumn("blocks", blocks).withColumn("quota", quota), [F.col("number")], stop="quota")
    return out.withColumn("stop", F.col("stop") + F.col("quota"))


def unrolling(spark: SparkSession, rows: int) -> int:
    """Partitions in which ``rows`` rows are unrolled."""
    return max(2 * spark.sparkContext.defaultParallelism, rows // TASK_ROWS)


def positions(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """``sized`` with ``number`` of the source and ``first``: words of the source before the document."""
    alike = sized.groupBy("source", "place", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("all", F.col("size") * F.col("copies"))
    numbered = alike.join(goal.select(F.col("source").alias("__s"), "number", "source_size", "target"), alike["source"].eqNullSafe(F.col("__s"))).drop("__s")
    numbered = numbered.withColumn("high", F.shiftrightunsigned("place", 56)).withColumn("mid", F.shiftrightunsigned("place", 48).bitwiseAND(F.lit(255)))
    mids = numbered.groupBy("number", "high", "mid").agg(F.sum("all").alias("mid_size"))
    highs = mids.groupBy("number", "high").agg(F.sum("mid_size").alias("high_size"))
    running = lambda keys, order, what: F.coalesce(F.sum(what).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    highs = highs.withColumn("before_high", running(["number"], ["high"], "high_size")).drop("high_size")
    mids = mids.withColumn("before_mid", running(["number", "high"], ["mid"], "mid_size")).drop("mid_size").join(highs, ["number", "high"])
    within = running(["number", "high", "mid"], ["place", "doc_id", "size"], "all")
    placed = numbered.withColumn("within", within).join(mids, ["number", "high", "mid"]).withColumn("first", F.col("before_high") + F.col("before_mid") + F.col("within"))
    runs = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    dealt = runs.repartition(unrolling(sized.sparkSession, sized.count()), "number", "first", "place", "copy")
    each = dealt.withColumn("copy", F.explode(F.sequence(F.col("copy"), F.least(F.col("copy") + COPIES, F.col("copies")) - 1)))
    return each.withColumn("first", F.col("first") + F.col("copy") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "number", "place", "first")


def segments(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document reaches into, with the words that it has there."""
    last = F.col("first") + F.col("size") - 1
    rows = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_words), F.floor(last / block_words))))
    start = F.greatest(F.col("first"), F.col("block") * block_words)
    stop = F.least(last + 1, (F.col("block") + 1) * block_words)
    return rows.withColumn("from_word", start - F.col("first")).withColumn("words", stop - start)


def draws(quota: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """``(shard, number, count)``: multinomial source counts of the output shards."""
    spark = quota.sparkSession
    width = max(1, -(-slots // max(CELLS, 4 * quota.count())))
    cells = quota.filter("quota > 0").select("number", (F.col("stop") - F.col("quota")).alias("start"), "stop")
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    drawn = spark.range(slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(slots, 1))).alias("ticket"))
    drawn = drawn.withColumn("cell", F.floor(F.col("ticket") / width))
    hit = (drawn["cell"] == cells["cell"]) & (drawn["ticket"] >= cells["start"]) & (drawn["ticket"] < cells["stop"])
    return drawn.join(cells, hit).groupBy("shard", "number").agg(F.count("*").alias("count"))


def permuted(index: Column, n: Column, *key) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 .. n-1 for each key."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), *key, r), n) + n - x, n)
        swap = F.xxhash64(F.lit("swap"), *key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def slots(quota: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``(shard, number, slot, block)``: what each output slot takes; slots count by source.

    Shards that make up for what was drawn too rarely count down from -1.
    """
    total_slots = quota.agg(F.coalesce(F.max("stop"), F.lit(0))).first()[0]
    drawn = materialize(draws(quota, total_slots, shard_slots, seed)).withColumn("group", F.floor(F.col("shard") / 1024))
    groups = drawn.groupBy("number", "group").agg(F.sum("count").alias("size"))
    groups = groups.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("number").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("count").over(W.partitionBy("number", "group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = drawn.withColumn("within", within).join(groups.drop("size"), ["number", "group"]).withColumn("start", F.col("before") + F.col("within"))
    kept = numbered.select("shard", "number", "start", (F.col("start") + F.col("count")).alias("end"))
    total = drawn.groupBy("number").agg(F.sum("count").alias("drawn"))
    rest = quota.select("number", "quota").join(total, "number", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long"))).withColumn("lacking", F.col("quota") - F.col("drawn"))
    rest = summed(rest.filter("lacking > 0"), [F.col("number")], before="lacking")
    rest = rest.withColumn("nth", F.explode(F.sequence(F.floor(F.col("before") / shard_slots), F.floor((F.col("before") + F.col("lacking") - 1) / shard_slots))))
    cut = lambda nth: F.col("drawn") + F.least("lacking", F.greatest(nth * shard_slots - F.col("before"), F.lit(0)))
    rest = rest.select((-1 - F.col("nth")).alias("shard"), "number", cut(F.col("nth")).alias("start"), cut(F.col("nth") + 1).alias("end"))
    runs = kept.unionByName(rest).join(quota.select("number", "blocks", "quota"), "number").withColumn("end", F.least("end", "quota")).filter("start < end")
    # few short rows unroll into all slots, so they are dealt out by the number of slots
    each = runs.repartition(unrolling(quota.sparkSession, total_slots)).withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    return each.select("shard", "number", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("number"), F.floor(F.col("slot") / F.col("blocks"))).alias("block"))


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 11) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it."""
    sized = materialize(sizes(docs))
    quota = materialize(quotas(targets(sized), block_words))
    placed = materialize(positions(sized, quota))
    times = slots(quota, shard_slots, seed).groupBy("number", "block").agg(F.count("*").alias("times"))
    got = segments(placed, block_words).join(times, ["number", "block"]).groupBy("number", "first").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # (number, first) is one document with words; those without share places and take nothing
    full = placed.filter("size > 0").join(got, ["number", "first"], "left")
    out = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return full.select(*out).unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def mixed_blocks(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 11) -> DataFrame:
    """The mix itself: ``(shard, slot, source, part, doc_id, words)``, the text pieces of each slot in order."""
    sized = materialize(sizes(docs))
    quota = materialize(quotas(targets(sized), block_words))
    placed = positions(sized, quota)
    texts = docs.select("doc_id", F.xxhash64(F.lit("place"), "doc_id", "text").alias("place"), "text").dropDuplicates(["doc_id", "place"])
    p = placed.filter("size > 0").alias("p").join(texts.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.place") == F.col("t.place"))).select("p.*", "text")
    # a text is cut into its pieces inside its row, so that no row but its own carries all of it
    low = F.floor(F.col("first") / block_words)
    blocks = F.sequence(low, F.floor((F.col("first") + F.col("size") - 1) / block_words))
    start = lambda b: F.greatest(b * block_words - F.col("first"), F.lit(0).cast("long"))
    piece = lambda words, b: F.array_join(F.slice(words, (start(b) + 1).cast("int"), ((b + 1) * block_words - F.col("first") - start(b)).cast("int")), " ")
    cut = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda words: F.transform(blocks, lambda b: F.struct(b.alias("block"), (F.col("first") + start(b)).alias("part"), piece(words, b).alias("piece"))))
    pieces = p.select("doc_id", "source", "number", F.explode(cut).alias("x")).select("doc_id", "source", "number", "x.*")
    return slots(quota, shard_slots, seed).join(pieces, ["number", "block"]).select("shard", "slot", "source", "part", "doc_id", F.col("piece").alias("text"))

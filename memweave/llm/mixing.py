"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame operations only).

Each source's documents are put into a reproducible shuffled order and laid end to end as one stream
of words, cut into blocks of ``block`` words. A golden-ratio sequence visits the unit interval almost
evenly; mapped through the sources' cumulative slot shares, its points name the source of each slot,
and the rank of a slot among its source's slots names the block it takes, starting over after the
last block. Slots above a source's need are dropped, the few that the sequence owes are appended.

Defined results: null or blank text has size 0 and takes nothing; a null source is a source of its
own, last in order; repeated rows are separate documents; an empty table gives an empty result.
Columns other than ``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, slim

BLOCK = 256
#: The golden ratio's fraction of 2**31, odd so that the sequence visits every value once a period.
GOLDEN, PERIOD = 1_327_217_885, 2**31
#: Slots whose ranks are counted together, and cells of the lookup from points to sources.
CHUNK, CELLS = 65_536, 4_096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of the whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return slim(docs, "doc_id", "text", "source").select("doc_id", "source", size.alias("size"))


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """A row for each source: pos, source, source_size, target, blocks, slots, lo, hi.

    Targets share ``share`` of all words by weight; no target exceeds ``most`` times its source. The
    level of the shares follows from the sources in order of (limit / weight): all below it are full.
    One row for each source meets in one task here, never one for each document.
    """
    by_ratio = Window.orderBy("ratio", "pos")
    s = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("pos") % len(weights) + 1))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("used", F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") * share - F.coalesce("used", F.lit(0))) / F.col("left_weight"))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight")))
    )
    words, size = F.floor("target"), F.col("source_size")
    by_pos = Window.orderBy("pos")
    return (
        s.withColumn("blocks", F.ceil(size / block))
        .withColumn("rounds", F.when(size > 0, F.floor(words / size)).otherwise(0))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil((words - F.col("rounds") * size) / block))
        .withColumn("upto", F.sum("slots").over(by_pos))
        .withColumn("all", F.sum("slots").over(Window.partitionBy()))
        .withColumn("lo", F.floor(F.when(F.col("all") > 0, (F.col("upto") - F.col("slots")) / F.col("all") * PERIOD).otherwise(0)))
        .withColumn("hi", F.floor(F.when(F.col("all") > 0, F.col("upto") / F.col("all") * PERIOD).otherwise(0)))
        .select("pos", "source", "source_size", "target", "blocks", "slots", "lo", "hi")
    )


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with pos and start, their place in their source's shuffled stream of words.

    Prefix sums in two steps: within buckets of the shuffled order, and over the buckets' sums.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = (
        sized.join(sources.select("pos", "source", "source_size", "target"), sized["source"].eqNullSafe(sources["source"]))
        .select("doc_id", sized["source"], "size", "source_size", "target", "pos", key.alias("key"))
        .withColumn("bucket", F.substring("key", 1, 3))
    )
    before = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("pos", "bucket").agg(F.sum("size").alias("n")).select("pos", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pos", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(sums, ["pos", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("key", "bucket", "base")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots in order: slot, pos, source, rank, block, words (of that block, from its start)."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    width = PERIOD // CELLS
    cells = (
        sources.where("hi > lo").select("pos", "lo", "hi")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    )
    point = F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * GOLDEN, F.lit(PERIOD))
    drawn = (
        spark.range(n).select("id", point.alias("point"), F.floor(point / width).alias("cell"))
        .join(cells, "cell").where("point >= lo and point < hi")
        .select("id", "pos", F.floor(F.col("id") / CHUNK).alias("chunk"))
    )
    counts = drawn.groupBy("pos", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("pos", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (
        drawn.join(base, ["pos", "chunk"])
        .select("id", "pos", (F.col("base") + F.row_number().over(Window.partitionBy("pos", "chunk").orderBy("id"))).alias("rank"))
    )
    got = counts.groupBy("pos").agg(F.sum("n").alias("got"))
    owed = (
        sources.join(got, "pos", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("slots > got")
        .select((F.lit(n) + F.col("pos")).cast("long").alias("id"), "pos", F.explode(F.sequence(F.col("got") + 1, F.col("slots"))).alias("rank"))
    )
    at = F.pmod(F.col("rank") - 1, F.col("blocks"))
    begin = F.floor((F.col("rank") - 1) / F.col("blocks")) * F.col("source_size") + at * block
    end = F.least(begin + block, (F.floor((F.col("rank") - 1) / F.col("blocks")) + 1) * F.col("source_size"), F.floor("target"))
    return (
        ranked.unionByName(owed).join(sources.drop("lo", "hi"), "pos").where(F.col("rank") <= F.col("slots"))
        .select(F.col("id").alias("slot"), "pos", "source", "rank", at.alias("block"), (end - begin).alias("words"))
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot: words of each document that the mix takes, and the first slot that takes any.

    Documents in order of first_slot are the mix in order of its schedule; -1 where nothing is taken.
    """
    sized = cut(sizes(docs))
    sources = cut(source_targets(sized, weights, share, most, block).coalesce(1))
    d = placed(sized, sources)
    uses = schedule(sources, block).groupBy("pos", "block").agg(F.collect_list(F.struct("slot", "words")).alias("offers"))  # at most `most` each
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = d.where("size > 0").select("pos", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    own = f"least(start + size, block * {block} + o.words) - greatest(start, block * {block})"
    took = F.expr(f"aggregate(offers, 0L, (n, o) -> n + greatest(0L, {own}))")
    slot = F.expr(f"array_min(transform(filter(offers, o -> {own} > 0), o -> o.slot))")
    taken = parts.join(uses, ["pos", "block"]).select("pos", "start", took.alias("n"), slot.alias("slot")).groupBy("pos", "start").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    out = d.join(taken.withColumn("some", F.lit(True)), [d["pos"] == taken["pos"], d["start"] == taken["start"], d["size"] > 0], "left")
    return out.select("doc_id", d["source"], d["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))

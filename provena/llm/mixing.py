"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Documents are hashed into BLOCKS blocks of each source. A source's target words are met by whole
copies of all its blocks, then further blocks in a permuted order, then single documents of the
last block in a permuted order. Each (block, copy) is a ticket; a binary tree deals the tickets to
output shards: at every node a uniformly random half goes left, so each source's count there is a
multivariate hypergeometric draw and the counts of all leaves add up to the source's quota. Those
quotas then cut the source's permuted tickets into disjoint runs, one for each shard.

Only one small row for each source leaves the aggregation, so documents are neither sorted nor
grouped by source. All draws come from hashes of a seed: reruns agree.

Defined results: a null text has size 0; null is a source of its own, ordered last; a source
without words has target 0 and nothing of it is taken; each row is drawn on its own, by its id, text
and source and a number inside equal rows, so rows without an id, or that share one, are taken like
others; an empty table gives an empty table; a column named like one that is added here (__key,
__copy, __source, __block, __order, __place, __plan, __times, __shards) is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import in_order, running
from .staging import staged

#: Blocks of a source, levels of the splitting tree (2 ** LEVELS shards), and how often a document may be taken.
BLOCKS, LEVELS, MOST = 1024, 4, 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(df: DataFrame) -> DataFrame:
    """df with __copy, a number from 1 on inside rows with the same __key, 0 where there is one row only.

    Rows that share a key are interchangeable, so which of them has which number is of no account.
    """
    repeated = staged(df.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"), "mixing-repeated")
    if repeated.isEmpty():
        return df.withColumn("__copy", F.lit(0).cast("long"))
    alone = df.join(repeated, "__key", "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    shared = running(in_order(df.join(repeated, "__key", "left_semi"), F.col("__key")), ["__key"], __copy=F.lit(1).cast("long"))
    return alone.unionByName(shared.select(*alone.columns))


def _draws(df: DataFrame, seed: int) -> DataFrame:
    """df, which has __key and __source, with the document's block, the block's place in its source's permutation, and the document's place in its block."""
    return (
        _numbered(df)
        .withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "__key", "__copy"), F.lit(BLOCKS)).cast("int"))
        .withColumn("__order", F.xxhash64(F.lit(seed + 1), F.col("__source"), F.col("__block")))
        .withColumn("__place", F.xxhash64(F.lit(seed + 2), "__key", "__copy"))
    )


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col)).alias("__key")


def targets(sources: DataFrame) -> DataFrame:
    """(__source, source_size) with weight and target: shares of all words by weight, none above MOST times its source's size.

    Ordered by cap over weight, the sources that meet their cap come first; the level at which the
    others share what is left is the largest of the levels after each of them.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("__source"))
    before, rest, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(rest))
    level = F.max("level").over(Window.partitionBy(F.lit(1)))
    return levels.withColumn("target", F.least(F.col("source_size") * F.lit(float(MOST)), level * F.col("weight"))).drop("level")


def _quotas(tickets: DataFrame, seed: int) -> DataFrame:
    """(__source, shard, quota): how many of each source's tickets the splitting tree deals to each shard."""
    node = tickets.select("__source", "ticket", F.lit(0).alias("shard"))
    for level in range(LEVELS):
        drawn = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 10 + level), F.col("__source"), F.col("ticket")), "__source", "ticket")
        all_there = Window.partitionBy("shard")
        node = node.select("__source", "ticket", (F.col("shard") * 2 + (F.row_number().over(drawn) * 2 > F.count(F.lit(1)).over(all_there) + (F.col("shard") % 2)).cast("int")).alias("shard"))
    return node.groupBy("__source", "shard").agg(F.count(F.lit(1)).alias("quota"))


def plan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The narrow table (id, source, size and draws) of all documents, and one row of decisions for each source.

    A source's row: source_size, target, copies of every block, last_order and last_place (the last
    block taken once more, and the last document of it), and the shards of its tickets by block and copy.
    """
    narrow = staged(documents.select(F.col(id_col).alias("__id"), _key(id_col, text_col, source_col), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size")), "mixing-narrow")
    sizes = staged(_draws(narrow, seed), "mixing-sizes")
    blocks = staged(sizes.groupBy("__source", "__block", "__order").agg(F.sum("size").alias("block_size")), "mixing-blocks")
    aims = targets(blocks.groupBy("__source").agg(F.sum("block_size").alias("source_size")))
    aims = aims.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    aims = staged(aims.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mixing-aims")

    order = Window.partitionBy("__source").orderBy("__order", "__block").rowsBetween(Window.unboundedPreceding, -1)
    reached = blocks.join(aims.withColumnRenamed("__source", "__aim"), F.col("__source").eqNullSafe(F.col("__aim"))).drop("__aim")
    reached = reached.withColumn("before", F.coalesce(F.sum("block_size").over(order), F.lit(0)))
    # The block in which the rest ends; blocks before it are taken whole.
    last = reached.where("before < rest and before + block_size >= rest")
    last = last.groupBy("__source").agg(F.max("__order").alias("last_order"), F.max("__block").alias("last_block"), F.max(F.col("rest") - F.col("before")).alias("words"))
    inside = sizes.join(last.withColumnRenamed("__source", "__aim"), F.col("__source").eqNullSafe(F.col("__aim")) & (F.col("__block") == F.col("last_block")))
    by_place = Window.partitionBy("__source", "__block").orderBy("__place", "__key", "__copy").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("size").over(by_place), F.lit(0))).where(F.col("before") + F.col("size") / 2 <= F.col("words"))
    ends = inside.groupBy("__source").agg(F.max("__place").alias("last_place"))

    tickets = staged(
        reached.select("__source", "__block", "__order", F.explode(F.sequence(F.lit(0), F.col("copies") + (F.col("before") < F.col("rest")).cast("int"))).alias("copy"), (F.col("copies") + (F.col("before") < F.col("rest")).cast("int")).alias("held"))
        .where("copy < held")
        .withColumn("ticket", F.row_number().over(Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed + 3), "__source", "__block", "copy"), "__block", "copy")) - 1),
        "mixing-tickets",
    )
    quotas = _quotas(tickets, seed)
    upto = Window.partitionBy("__source").orderBy("shard")
    runs = quotas.withColumn("end", F.sum("quota").over(upto))
    dealt = tickets.join(runs.select(F.col("__source").alias("__aim"), "shard", "quota", "end"), F.col("__source").eqNullSafe(F.col("__aim")) & (F.col("ticket") >= F.col("end") - F.col("quota")) & (F.col("ticket") < F.col("end")))
    shards = _shard_arrays(dealt)

    decisions = aims
    for part in (last.select("__source", "last_order"), ends, shards):
        part = part.withColumnRenamed("__source", "__aim")
        decisions = decisions.join(part, F.col("__source").eqNullSafe(F.col("__aim")), "left").drop("__aim")
    return sizes, staged(decisions.select("__source", "source_size", "target", "copies", "rest", "last_order", "last_place", "shards"), "mixing-decisions")


def _shard_arrays(dealt: DataFrame) -> DataFrame:
    """(__source, shards): the shard of each ticket at place block * MOST + copy, -1 where there is none."""
    every = dealt.select("__source").distinct().select("__source", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS * MOST - 1))).alias("k"), F.lit(-1).alias("shard"))
    there = dealt.select("__source", (F.col("__block") * MOST + F.col("copy")).alias("k"), "shard")
    full = every.union(there).groupBy("__source", "k").agg(F.max("shard").cast("tinyint").alias("shard"))
    return full.groupBy("__source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "shard"))), lambda s: s["shard"]).alias("shards"))


def _taken(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """df, which has __source and the draws, with __plan (its source's decisions), __times (how often each document is taken) and __shards."""
    aims = decisions.select(F.col("__source").alias("__aim"), F.struct(*[c for c in decisions.columns if c != "__source"]).alias("__plan"))
    joined = df.join(aims, F.col("__source").eqNullSafe(F.col("__aim")), "left").drop("__aim")
    of = lambda name: F.col("__plan")[name]
    once_more = (F.col("__order") < of("last_order")) | ((F.col("__order") == of("last_order")) & (F.col("__place") <= of("last_place")))
    times = F.coalesce(of("copies"), F.lit(0)) + F.coalesce((of("rest") > 0) & once_more, F.lit(False)).cast("int")
    return joined.withColumn("__times", times).withColumn("__shards", F.slice(of("shards"), F.col("__block") * MOST + 1, F.col("__times")))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, taken (words, repeats counted), times, and shards, one for each time."""
    sizes, decisions = plan(documents, id_col, text_col, source_col, seed)
    out = _taken(sizes, decisions)
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), "size", "__plan.source_size", "__plan.target", (F.col("size") * F.col("__times")).alias("taken"), F.col("__times").alias("times"), F.col("__shards").alias("shards"))


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns and __shard. Rows are brought together by shard, shards one after another over the partitions, and within a shard in an order drawn by hash."""
    _, decisions = plan(documents, id_col, text_col, source_col, seed)
    columns = documents.columns
    keyed = documents.select("*", _key(id_col, text_col, source_col), F.col(source_col).alias("__source"))
    rows = _taken(_draws(keyed, seed), decisions)
    dealt = rows.select(*columns, F.posexplode("__shards").alias("__time", "__shard"), F.xxhash64(F.lit(seed + 4), "__key", "__copy").alias("__row")).withColumn("__drawn", F.xxhash64("__row", "__time"))
    return dealt.repartitionByRange("__shard", "__drawn").sortWithinPartitions("__shard", "__drawn").drop("__time", "__row", "__drawn")

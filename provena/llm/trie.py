"""Prefix trie of conversations by preorder intervals.

A node is a distinct beginning of a conversation, known by the depth and two running sums of hashes
of (turn's digest, place): beginnings are equal exactly if their sums are, but for a chance of
2 ** -128. Nodes are ranked lexicographically, so that a subtree is one interval: from its top to the
last leaf below it, whose place is stored as the subtree's end. Leaves and savings of a subtree are
then differences of two prefix sums over the ranked nodes.

A path is written as the digests chosen at forks only, so a long conversation that nobody shares has
a short path; a path of n forks needs n other conversations that leave it at different depths, and
so at least n * n / 2 turns of input. Runs of nodes without a fork are ordered by depth.

Nothing needs all turns of a conversation, all members of a node or all children of a node in one
task: places and sums are taken over range parts (order.py), members are counted with partial
aggregates, joins by node are split by adaptive execution. Only the digest of a node's ended members
is one after another by its nature; it reads their ids in lists of CHUNK, one list at a time.

Defined results: rows without conv_id belong to no conversation and are left out; null turns come
first; rows of one conversation with the same turn are ordered by the digest of role and text, and
repeated rows are turns of their own; null roles and texts are empty; a conversation without turns is
a member of the root; an empty table has no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import AT, in_order, running
from .staging import staged

#: Conversations that share the head of the first of them, and one more than the longest head.
FAMILY, HEADS = 20, 4
#: Ids in a list when the ids of a node's ended members are joined.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
WIDE = "decimal(38,0)"


def _hashes(digest: Column, depth: Column) -> list[Column]:
    """Two independent 64-bit hashes of a turn at its place, as wide decimals that can be summed."""
    return [F.xxhash64(F.lit(seed), digest, depth.cast("long")).cast(WIDE) for seed in (11, 12)]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", depth.cast("string"), *[s.cast("string") for s in sums])))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, digest, tokens, ends): a row for each beginning of each rebuilt conversation, the empty one included.

    A conversation takes the first of its family's head turns, as many as its id draws, and goes on
    with its own turns after as many. At most HEADS - 1 turns of a conversation are ever carried
    to others.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    ordered = in_order(turns, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"))
    placed = staged(running(ordered, ["conv"], place=F.lit(1).cast("long")).drop("turn"), "trie-turns")

    head = F.when(F.col("place") < HEADS, F.struct("place", "digest", "tokens"))
    known = placed.groupBy("conv").agg(F.array_sort(F.collect_list(head)).alias("first"), F.count(F.lit(1)).alias("n"))
    drawn = F.crc32(F.col("conv").cast("string")) % HEADS
    asked = known.select("conv", "n", drawn.cast("int").alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    of_base = known.select(F.col("conv").alias("base"), "first")
    heads = F.slice(F.coalesce("first", F.expr("cast(array() as array<struct<place:bigint,digest:binary,tokens:bigint>>)")), F.lit(1), F.col("h"))
    family = asked.join(of_base, "base", "left").withColumn("heads", heads)
    sums = lambda k: F.transform("heads", lambda t, n: F.aggregate(F.slice("heads", F.lit(1), n + 1), F.lit(0).cast(WIDE), lambda s, x: (s + _hashes(x["digest"], x["place"])[k]).cast(WIDE)))
    length = F.size("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    family = staged(family.select("conv", "h", "heads", length.cast("long").alias("length"), sums(0).alias("s0"), sums(1).alias("s1")), "trie-heads")

    zero = F.lit(0).cast(WIDE)
    start = family.select("conv", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("tokens"), *[zero.alias(c) for c in ("s0", "s1", "x0", "x1")])
    begun = family.select("conv", "length", "s0", "s1", F.posexplode("heads").alias("i", "t"))
    x0, x1 = _hashes(F.col("t.digest"), F.col("t.place"))
    begun = begun.select("conv", "length", F.col("t.place").alias("depth"), F.col("t.digest").alias("digest"), F.col("t.tokens").alias("tokens"), F.get("s0", F.col("i")).alias("s0"), F.get("s1", F.col("i")).alias("s1"), x0.alias("x0"), x1.alias("x1"))
    last = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), zero)
    own = placed.join(family.select("conv", "h", "length", F.size("heads").alias("k"), last("s0").alias("b0"), last("s1").alias("b1")), "conv").where("place > h")
    own = own.withColumn("depth", F.col("place") - F.col("h") + F.col("k"))
    x0, x1 = _hashes(F.col("digest"), F.col("depth"))
    own = running(own.withColumn("x0", x0).withColumn("x1", x1), ["conv"], r0=F.col("x0"), r1=F.col("x1"))
    own = own.select("conv", "length", "depth", "digest", "tokens", (F.col("r0") + F.col("b0")).cast(WIDE).alias("s0"), (F.col("r1") + F.col("b1")).cast(WIDE).alias("s1"), "x0", "x1")

    rows = start.union(begun).union(own)
    before = [(F.col("s0") - F.col("x0")).cast(WIDE), (F.col("s1") - F.col("x1")).cast(WIDE)]
    parent = F.when(F.col("depth") > 0, _key(F.col("depth") - 1, before))
    return staged(rows.select("conv", "depth", _key(F.col("depth"), [F.col("s0"), F.col("s1")]).alias("node"), parent.alias("parent"), "digest", "tokens", (F.col("depth") == F.col("length")).alias("ends")), "trie-rows")


def nodes(rows: DataFrame) -> DataFrame:
    """(node, parent, depth, tokens, conv_id, n_convs, n_children, parent_conv_id, forked) from rebuilt(); forked: its parent has several children."""
    each = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max("tokens").alias("tokens"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    each = staged(each, "trie-nodes")
    below = each.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    each = staged(each.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    above = each.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("forked"))
    return staged(each.join(above, "parent", "left").withColumn("forked", F.coalesce("forked", F.lit(False))), "trie-linked")


def intervals(rows: DataFrame, each: DataFrame) -> DataFrame:
    """each, from nodes(), with AT (the preorder place), end_at (the place of the last node below it), n_leaves and saved_tokens.

    One conversation of each leaf is enough: together they pass every node.
    """
    leaves = each.where("n_children = 0")
    spine = rows.join(leaves.select(F.col("conv_id").alias("conv")), "conv", "left_semi")
    spine = staged(spine.join(each.select("node", "forked"), "node").select("conv", "node", F.when(F.col("forked"), F.struct("depth", "digest")).alias("fork")), "trie-spine")
    paths = staged(spine.where("fork IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list("fork")).alias("forks")), "trie-paths")
    via = spine.groupBy("node").agg(F.min("conv").alias("conv"))
    routed = each.join(via, "node").join(paths, "conv", "left")
    chosen = F.transform(F.filter("forks", lambda f: f["depth"] <= F.col("depth")), lambda f: f["digest"])
    routed = routed.withColumn("path", F.coalesce(chosen, F.expr("cast(array() as array<binary>)"))).drop("conv", "forks")
    ranked = in_order(routed, F.col("path"), F.col("depth")).drop("path")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("tokens")
    summed = staged(running(ranked, [], upto_leaves=leaf, upto_saved=saved), "trie-ranked")
    ends = summed.where("n_children = 0").select(F.col("conv_id").alias("conv"), F.struct(F.col(AT).alias("at"), "upto_leaves", "upto_saved").alias("end"))
    end = spine.join(ends, "conv").groupBy("node").agg(F.max("end").alias("end"))
    out = summed.join(end, "node")
    return out.select(*each.columns, AT, F.col("end.at").alias("end_at"), (F.col("end.upto_leaves") - F.col("upto_leaves") + leaf).alias("n_leaves"), (F.col("end.upto_saved") - F.col("upto_saved") + saved).alias("saved_tokens"))


def ended(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: the digest of their ids, ascending, joined by commas."""
    ordered = in_order(rows.where("ends").select("node", "conv"), F.col("node"), F.col("conv"))
    numbered = running(ordered, ["node"], place=F.lit(1).cast("long"))
    lists = numbered.groupBy("node", F.floor((F.col("place") - 1) / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    lists = staged(lists, "trie-ended")
    long = lists.where("chunk > 0").select("node").distinct()
    short = lists.join(long, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node != now and now is not None:
                    out.append((now, sha.hexdigest()))
                    sha = hashlib.sha256()
                elif now is not None:
                    sha.update(b",")
                now = node
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    streamed = lists.join(long, "node", "left_semi").repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return short.union(streamed.mapInArrow(hashed, "node binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its interval of places preorder to preorder_end."""
    rows = rebuilt(conversations)
    spans = intervals(rows, nodes(rows))
    out = spans.join(ended(rows), "node", "left")
    nothing = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), F.col(AT).alias("preorder"), F.col("end_at").alias("preorder_end"))


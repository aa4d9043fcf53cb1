"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Documents with equal sets form one class, and
only one of each class goes on. Each of TREES independent trees sends a set to the child named by
one minwise value; a child is a node. With 16 trees a pair at similarity 0.75 shares no node with
probability 0.25 ** 16.

Groups of copies must not cost all their pairs. So every node first offers each member PIVOTS of its
members, each set keeps the OFFERS nearest by sketch, and confirmed offers are joined into
components. Nodes that hold a single component are done. In any other, the members outside its
largest component are compared with all of another component: a link inside a component changes no
component, so none is lost. A node with more than LEAF such members branches again on BRANCHES
further minwise values that it chooses, as long as its children have fewer pairs together than it
has itself, down to DEPTH levels: sets that share one common line part, a group of copies at like
similarity doesn't, and is compared as it is.

Nodes are compared in cells of BLOCK by BLOCK members, so that a large one is dealt over tasks; a
pair that shares several nodes is tested in the least of them. Cells screen pairs by sketches of
1,024 one-bit minwise values (a pair at 0.75 fails with probability 1e-5), then confirm them on the
full shingle sets, which each cell reads once. Neither step writes pairs, only lists of partners
and, at the end, links between components.

Defined results: null texts and texts without words have the empty set and link with nothing; texts
under five words have one shingle, all their words; rows that repeat an id with the same text are one
document; rows that repeat an id with another text, and rows without an id, are compared as documents
of their own; of a component the document with the smallest id, null last, and then row key is kept,
so ties fall alike in every run; very long texts are sets like others, held one at a time; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, map_batches, record_batch
from .components import components
from .rowkey import row_key
from .staging import staged

WIDTH, POSITIONS, TREES, BRANCHES, DEPTH, LEAF, PIVOTS, OFFERS = 5, 64, 16, 4, 4, 1000, 4, 3
#: Bits of a sketch, and in how many a pair may differ: 128 expected at similarity 0.75, and 4.5 deviations more. FIRST: the same for the first 256 bits, 32 and 5 deviations.
BITS, SCREEN, FIRST = 1024, 176, 59
#: Sets, and shingles, that a side of a cell holds about; pairs that are screened at once.
BLOCK, BLOCK_SHINGLES, AT_ONCE = 1024, 300_000, 1 << 17
#: Into how many cells the offers of one pivot are dealt.
DEALT = 64
#: Ids of candidate documents up to which they are broadcast to pick texts (8 bytes each); beyond, texts are joined by shuffle.
BROADCAST_IDS = 1_000_000

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20_240_601)
_MULTIPLY = _random.integers(0, 2**31, BITS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 2**32, BITS, np.uint32)


class _WordHashes(dict):
    """64-bit hash of each distinct word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _PRIME + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def minwise(found: np.ndarray) -> np.ndarray:
    """The least value of each of BITS hash functions."""
    best, values = np.full(BITS, np.iinfo(np.uint32).max, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(values), 64):
        hashed = values[start : start + 64, None] * _MULTIPLY
        hashed += _ADD
        np.minimum(best, hashed.min(0), out=best)
    return best


def _sets(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, n_shingles, digest, minwise array<int>, sketch array<long>), key being the row's: the last three null for the empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, values, sketches = [], [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            if not len(found):
                digests.append(None)
                values.append(None)
                sketches.append(None)
                continue
            least = minwise(found)
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            values.append(least[:POSITIONS].view(np.int32))
            sketches.append(np.packbits(((least >> np.uint32(13)) & np.uint32(1)).astype(bool)).view(np.int64))
        return record_batch(key=batch.column(0), id=batch.column(1), n_shingles=pa.array(sizes, pa.int64()), digest=pa.array(digests, pa.binary()), minwise=pa.array(values, pa.list_(pa.int32())), sketch=pa.array(sketches, pa.list_(pa.int64())))

    rows = documents.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "key long, id long, n_shingles long, digest binary, minwise array<int>, sketch array<long>")


def _full_sets(documents: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles array<long>) of the documents whose row keys are in ids, one row for each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        lengths = np.array([len(f) for f in found])
        return record_batch(id=batch.column(0), shingles=list_array(np.concatenate(found), lengths, pa.int64()))

    small = ids.count() <= BROADCAST_IDS
    rows = documents.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    return map_batches(rows, run, "id long, shingles array<long>").dropDuplicates(["id"])


def _apart(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITS // 64)])


def _offers(members: DataFrame) -> DataFrame:
    """For each set the OFFERS nearest sets among the pivots of its nodes, as cells for confirm()."""
    pivots = [F.min(F.struct(F.xxhash64(F.lit(k), F.col("id")).alias("h"), "id", "sketch")) for k in range(PIVOTS)]
    nodes = members.groupBy("node").agg(F.array_distinct(F.transform(F.array(*pivots), lambda p: F.struct(p["id"].alias("other"), p["sketch"].alias("its")))).alias("pivots"))
    offers = members.join(nodes, "node").select("id", "sketch", F.inline("pivots")).where("id != other")
    near = offers.select("id", "other", _apart("sketch", "its").alias("apart")).where(F.col("apart") <= SCREEN)
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "other"))), 1, OFFERS).alias("best"))
    pairs = best.select("id", F.explode("best.other").alias("other"))
    pairs = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
    pairs = pairs.withColumn("cell", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.lit(DEALT))))
    asking = pairs.select("cell", F.lit(True).alias("asks"), F.col("a").alias("id"), F.col("a").alias("component"), F.array("b").alias("partners"))
    asked = pairs.select("cell", F.lit(False), "b", "b", F.array().cast("array<long>")).distinct()
    return asking.union(asked)


def confirm(documents: DataFrame, cells: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between components, found in cells (cell, asks, id, component, partners).

    A row that asks is compared with its partners, which are rows of the same cell that don't ask:
    100 * intersection >= percent * union of the full sets.
    """
    ids = staged(cells.select("id").distinct(), "neardup-ids")
    full = _full_sets(documents, ids, id_col, text_col)
    rows = cells.join(full, "id").select("cell", "asks", "id", "component", "partners", "shingles").repartition("cell").sortWithinPartitions("cell", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, _Asked()
        for batch in batches:
            found: set[tuple[int, int]] = set()
            names, asks, ids, owners = (batch.column(k).to_pylist() for k in range(4))
            partners, shingles = batch.column(4), batch.column(5)
            for n, cell in enumerate(names):
                if cell != now:
                    now, asked = cell, _Asked()
                one = shingles[n].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if asks[n]:
                    found.update((owners[n], c) for c in asked.near(one, partners[n].values.to_pylist(), percent) if c != owners[n])
                else:
                    asked.add(ids[n], owners[n], one)
            if found:
                a, b = zip(*sorted(found))
                yield record_batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return staged(rows.mapInArrow(run, "a long, b long").distinct(), "neardup-links")


class _Asked:
    """The sets of a cell that others are compared with."""

    def __init__(self) -> None:
        self.sets: dict[int, tuple[int, np.ndarray]] = {}
        self.index: tuple | None = None

    def add(self, name: int, component: int, found: np.ndarray) -> None:
        self.sets[name] = component, found.copy()

    def near(self, one: np.ndarray, partners: list[int], percent: int) -> set[int]:
        """Components of the partners that are similar enough to the set one."""
        if len(partners) < 16:
            common = [len(np.intersect1d(one, self.sets[p][1], assume_unique=True)) for p in partners]
            sizes = [len(self.sets[p][1]) for p in partners]
            return {self.sets[p][0] for p, m, c in zip(partners, sizes, common) if 100 * c >= percent * (m + len(one) - c)}
        if self.index is None:  # all sets of the cell as places in one vocabulary
            sizes = np.array([len(s) for _, s in self.sets.values()])
            words, places = np.unique(np.concatenate([s for _, s in self.sets.values()]), return_inverse=True)
            self.index = words, places, np.cumsum(sizes) - sizes, sizes, np.array([c for c, _ in self.sets.values()]), {p: k for k, p in enumerate(self.sets)}
        words, places, starts, sizes, components, order = self.index
        known = np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(words, one), len(words) - 1)
        known[at[words[at] == one]] = 1
        common = np.add.reduceat(known[places], starts)
        near = 100 * common >= percent * (sizes + len(one) - common)
        listed = np.fromiter((order[p] for p in partners), np.int64, len(partners))
        return set(components[listed[near[listed]]].tolist())


def _labelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """members with each set's component."""
    out = members.join(joined.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")
    return out.withColumn("component", F.coalesce("component", "id"))


def _open(members: DataFrame) -> DataFrame:
    """(node, n, shingles, main, outside) of the nodes with several components: main is the largest, outside the number of the others' members."""
    shares = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    nodes = shares.groupBy("node").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "component")).alias("largest"))
    return nodes.where("n > largest.n").select("node", "n", "shingles", F.col("largest.component").alias("main"), (F.col("n") - F.col("largest.n")).alias("outside"))


def _children(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the next level: each node chooses BRANCHES positions, and a member's values there name its children."""
    place = lambda k: F.pmod(F.xxhash64("node", k), F.lit(POSITIONS)).cast("int")
    named = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(BRANCHES)), lambda k: F.xxhash64("node", place(k), F.get("minwise", place(k)))))
    return members.join(classes.select("id", "minwise"), "id").select(*members.columns, F.explode(named).alias("child"))


def _levels(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of all nodes that are to be compared, with _open()'s columns."""
    done = None
    for depth in range(DEPTH):
        opened = staged(members.join(_open(members), "node"), "neardup-open")
        if depth == DEPTH - 1 or opened.where(F.col("outside") > LEAF).isEmpty():
            return opened if done is None else done.union(opened)
        large = opened.where(F.col("outside") > LEAF)
        children = staged(_children(large, classes), "neardup-children")
        sizes = children.groupBy("child", "node", "n").agg(F.count(F.lit(1)).alias("m"))
        parting = sizes.groupBy("node", "n").agg(F.sum(F.col("m") * F.col("m")).alias("pairs")).where("pairs < n * n").select("node")
        parting = staged(parting, "neardup-parting")
        if parting.isEmpty():
            return opened if done is None else done.union(opened)
        whole = opened.where(F.col("outside") <= LEAF).union(large.join(parting, "node", "left_anti").select(*opened.columns))
        done = whole if done is None else done.union(whole)
        shared = sizes.where("m > 1").select("child").distinct()
        members = children.join(parting, "node", "left_semi").join(shared, "child").select(F.col("child").alias("node"), *[c for c in members.columns if c != "node"])
        members = staged(members, "neardup-nodes")
    return done


def _cells(compared: DataFrame) -> DataFrame:
    """Rows (cell, role, node, id, component, inside, n_shingles, sketch, nodes) of _levels(): role 0 is asked, 1 asks, 2 does both; nodes: all that the set is compared in."""
    nodes = compared.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    parts = lambda share: F.greatest(F.ceil(share / BLOCK), F.ceil(F.col("shingles") * share / F.col("n") / BLOCK_SHINGLES)).cast("int")
    rows = compared.join(nodes, "id").withColumn("rows", parts(F.col("outside"))).withColumn("columns", parts(F.col("n")))
    rows = rows.withColumn("inside", F.col("component") == F.col("main"))
    row, column = F.pmod(F.xxhash64("id"), F.col("rows")), F.pmod(F.xxhash64("id"), F.col("columns"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, role: F.struct(F.xxhash64("node", i.cast("int"), j.cast("int")).alias("cell"), F.lit(role).alias("role"))
    asked = F.transform(upto(F.col("rows")), lambda i: cell(i, column, 0))
    asks = F.transform(upto(F.col("columns")), lambda j: cell(row, j, 1))
    single = (F.col("rows") == 1) & (F.col("columns") == 1)
    dealt = F.when(F.col("inside"), asked).when(single, F.array(cell(F.lit(0), F.lit(0), 2))).otherwise(F.concat(asked, asks))
    return rows.select(F.inline(dealt), "node", "id", "component", "inside", "n_shingles", "sketch", "nodes")


def _screened(compared: DataFrame, percent: int) -> DataFrame:
    """Cells for confirm(): sets with the partners that their sketches let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            out = _partners(table, percent)
            if out.num_rows:
                yield out

    rows = _cells(compared).repartition("cell").sortWithinPartitions("cell")
    return staged(rows.mapInArrow(run, "cell long, asks boolean, id long, component long, partners array<long>"), "neardup-cells")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut where a cell ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        ends = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        if rest and len(cells) and rest[-1].column(0)[-1].as_py() != cells[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if len(ends):
            yield pa.Table.from_batches([*rest, batch.slice(0, ends[-1])])
            rest = []
            batch = batch.slice(ends[-1])
        if batch.num_rows:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _partners(table: pa.Table, percent: int) -> pa.RecordBatch:
    """The screened partners in whole cells of _cells()."""
    table = table.combine_chunks()
    cell, role, node, name, component, inside, size = (table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(7))
    sketch = _matrix(table.column(7)).view(np.uint64)
    lists = _padded(table.column(8))
    starts = np.append(0, np.flatnonzero(cell[1:] != cell[:-1]) + 1)
    lengths = np.diff(np.append(starts, len(cell)))
    first, many = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    asks = np.flatnonzero(role > 0)
    upto = np.cumsum(many[asks])
    left, right, at = [], [], 0
    while at < len(asks):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        rows = asks[at:end]
        at = end
        a = np.repeat(rows, many[rows])
        b = np.arange(len(a)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows]) + first[a]
        fit = (role[b] != 1) & (component[a] != component[b]) & (inside[b] | (name[a] < name[b]))
        fit &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        for words, most in ((slice(0, 4), FIRST), (slice(0, None), SCREEN)):
            a, b = a[fit], b[fit]
            fit = np.bitwise_count(sketch[a, words] ^ sketch[b, words]).sum(1) <= most
        a, b = a[fit], b[fit]
        for k in range(lists.shape[1]):  # a pair belongs to the least node that it shares
            shared = lists[a, k]
            fit = (shared >= node[a]) | ~(lists[b] == shared[:, None]).any(1)
            a, b = a[fit], b[fit]
        left.append(a)
        right.append(b)
    a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
    asking, counts = np.unique(a, return_counts=True)  # a is in order
    asked = np.unique(b)
    rows = np.append(asking, asked)
    partners = list_array(name[b], np.append(counts, np.zeros(len(asked), np.int64)), pa.int64())
    return record_batch(cell=pa.array(cell[rows]), asks=pa.array(np.arange(len(rows)) < len(asking)), id=pa.array(name[rows]), component=pa.array(component[rows]), partners=partners)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists as rows of a matrix, filled up with the greatest number."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), int(lengths.max(initial=1))), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def joined_classes(documents: DataFrame, classes: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of the classes (id, n_shingles, minwise, sketch) that link with another."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.get("minwise", t)))
    rows = classes.select("id", F.explode(nodes).alias("node"))
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("node")
    members = rows.join(shared, "node").join(classes.select("id", "n_shingles", "sketch"), "id")
    members = staged(members.select("id", "node", "n_shingles", "sketch", F.col("id").alias("component")), "neardup-nodes")
    offered = components(confirm(documents, staged(_offers(members), "neardup-offers"), percent, id_col, text_col))
    labelled = staged(_labelled(members.drop("component"), offered), "neardup-nodes")
    more = components(confirm(documents, _screened(_levels(labelled, classes), percent), percent, id_col, text_col))
    every = offered.union(more.select("id").join(offered.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    return every.join(more.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def without_copies(documents: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents, all columns, without those that near_duplicates() doesn't keep."""
    lost = staged(_judged(documents, percent, id_col, text_col).where("not kept").select(F.col("key").alias("__lost")).distinct(), "neardup-lost")
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    return documents.join(lost, row_key(id_col, text_col) == F.col("__lost"), "left_anti")


def near_duplicates(documents: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_shingles, component_id (the smallest id reachable), kept (the document is the component's first)."""
    return _judged(documents, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _judged(documents: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() with id and the row's key. Sets are named by the least row key of their class."""
    sets = staged(_sets(documents, id_col, text_col), "neardup-sets")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first")
    classes = staged(sets.where("digest is not null").groupBy("digest").agg(first, F.min("key").alias("set"), F.first("n_shingles").alias("n_shingles"), F.first("minwise").alias("minwise"), F.first("sketch").alias("sketch")), "neardup-classes")
    joined = joined_classes(documents, classes.select(F.col("set").alias("id"), "n_shingles", "minwise", "sketch"), percent, id_col, text_col)
    named = classes.select("digest", "set", "first").join(joined, F.col("set") == F.col("id"), "left").select(F.col("digest").alias("__d"), F.coalesce("component", "set").alias("component"), "first")
    named = staged(named, "neardup-named")
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    named = staged(named.drop("first").join(firsts, "component").select("__d", "first"), "neardup-named")
    out = sets.select("key", "id", "n_shingles", "digest").join(named, F.col("digest") == F.col("__d"), "left")
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return out.select("key", "id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == F.col("first.key"), F.lit(True)).alias("kept"))

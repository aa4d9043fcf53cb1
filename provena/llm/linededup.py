"""Line dedup by a segment-partition edit join. DataFrame and SQL functions only.

Lines are equal or within EDITS edits of each other; components of such links are classes, and the
first line of a class, by document id, row key and place, stays. A line of LEAST characters or more is cut
into EDITS + 1 segments, of which one at least stands unchanged in any line within EDITS edits. A
line's keys are its own segments (index) and, for each length it may match, the substrings at the
places where that length's segment can stand (probe); both carry length and segment number. Lines
that share a key are compared. In a group of many lines each first meets the group's first line,
and only pairs that this leaves in different components are compared further. Candidates are
verified with an edit distance banded at EDITS.

Lines travel as 64-bit hashes; the text of a line is read again only for candidates.

Defined results: null counts as an empty text; lines without a word are always kept and never
compared; lines under LEAST characters are joined only if equal; rows that repeat an id with the same
text are one document, and its lines are dropped alike in each; rows that repeat an id with another
text, and rows without an id, are documents of their own; a document may become empty; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .rowkey import row_key
from .staging import staged

EDITS, LEAST = 2, 16
#: Lines of a class from which all but the first are dropped.
COPIES = 2
#: Ids of candidate lines up to which they are broadcast to pick their texts (8 bytes each); beyond, lines are joined by shuffle.
BROADCAST_IDS = 1_000_000
WORD = r"[^\x20\x09-\x0D]"


def segment(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of EDITS + 1, the last ones longer by one where the length isn't divisible."""
    parts = EDITS + 1
    short = F.floor(length / parts).cast("int")
    longer = length - short * parts
    before = F.greatest(F.lit(0), longer - (parts - (i - 1)))
    return short * (i - 1) + before + 1, short + (F.lit(i) > parts - longer).cast("int")


def keys(line: Column, length: Column) -> list[tuple[Column, bool]]:
    """The line's keys and whether each is its own segment: the places at which a line of up to EDITS characters less can have its segments."""
    out = []
    for less in range(EDITS + 1):
        other = length - less
        for i in range(1, EDITS + 2):
            start, size = segment(other, i)
            for shift in range(max(1 - i, less - (EDITS + 1 - i)), min(i - 1, less + EDITS + 1 - i) + 1):
                out.append((F.xxhash64(other, F.lit(i), F.substring(line, start + shift, size)), less == 0 and shift == 0))
    return sorted(out, key=lambda k: not k[1])


def _lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, place, line, hash) of every line with a word; key: the row's."""
    rows = documents.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("place", "line"))
    return rows.where(F.col("line").rlike(WORD)).withColumn("hash", F.xxhash64("line"))


def _texts(documents: DataFrame, hashes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, line): one row for each of the hashes."""
    small = hashes.count() <= BROADCAST_IDS
    lines = _lines(documents, id_col, text_col).select("hash", "line").join(F.broadcast(hashes) if small else hashes, "hash", "left_semi")
    return lines.groupBy("hash").agg(F.min("line").alias("line"))


def links(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): hashes of different lines within EDITS edits, enough of them to join all lines that any links join."""
    long = _lines(documents, id_col, text_col).withColumn("length", F.length("line")).where(F.col("length") >= LEAST)
    found = keys(F.col("line"), F.col("length"))
    own = sum(is_own for _, is_own in found)
    distinct = long.select("hash", F.array(*[k for k, _ in found]).alias("keys")).groupBy("hash").agg(F.first("keys").alias("keys"))
    rows = distinct.select("hash", F.posexplode("keys").alias("n", "key")).select("key", "hash", (F.col("n") < own).alias("own"))
    group = Window.partitionBy("key")
    shared = rows.withColumn("least", F.min("hash").over(group)).withColumn("most", F.max("hash").over(group)).withColumn("owned", F.max("own").over(group))
    members = staged(shared.where("least != most and owned").select("key", "hash", "own", "least").distinct(), "lines-members")
    texts = staged(_texts(documents, staged(members.select("hash").distinct(), "lines-ids"), id_col, text_col), "lines-texts")
    near = F.levenshtein("x", "y", EDITS) >= 0  # a condition of the join, so only links leave it
    stars = members.where("hash != least").select("hash", "least").distinct().join(texts.withColumnRenamed("line", "x"), "hash")
    first = stars.join(texts.select(F.col("hash").alias("least"), F.col("line").alias("y")), "least").where(near)
    first = staged(first.select(F.col("least").alias("a"), F.col("hash").alias("b")), "lines-links")
    joined = components(first)
    placed = members.join(joined, F.col("hash") == F.col("id"), "left").select("key", "hash", "own", "least", F.coalesce("component", "hash").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 != c1 and n > 2").select("key")
    rest = placed.join(mixed, "key").join(texts, "hash")
    one = rest.where("own").select("key", F.col("hash").alias("a"), F.col("component").alias("ca"), F.col("line").alias("x"))
    two = rest.select("key", F.col("hash").alias("b"), F.col("component").alias("cb"), F.col("line").alias("y"), "least")
    # The pairs with a group's first line are known.
    pairs = one.join(two, "key").where((F.col("ca") != F.col("cb")) & (F.col("a") != F.col("least")) & (F.col("b") != F.col("least")) & near)
    return first.union(staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "lines-links"))


def dropped_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES) -> DataFrame:
    """(key, drop array<int>): the places of the lines that the documents of a row key lose; those that lose none are absent."""
    seen = staged(_lines(documents, id_col, text_col).select("id", "key", "place", "hash"), "lines-seen")
    distinct = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "place")).alias("first"))
    joined = components(links(documents, id_col, text_col)).withColumnRenamed("id", "member")
    classed = distinct.join(joined, F.col("hash") == F.col("member"), "left").select("hash", F.coalesce("component", "hash").alias("class"), "n", "first")
    classed = staged(classed, "lines-classes")
    several = classed.groupBy("class").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= copies).select("class", F.col("first").alias("kept"))
    repeated = classed.select("hash", "class").join(several, "class").select("hash", "kept")
    lost = seen.join(repeated, "hash").where((F.col("key") != F.col("kept.key")) | (F.col("place") != F.col("kept.place")))
    return lost.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("drop"))


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES) -> DataFrame:
    """documents, all columns, with the lines of dropped_lines() taken out of the text, and __dropped, how many those are."""
    drops = dropped_lines(documents, id_col, text_col, copies).select(F.col("key").alias("__key"), F.col("drop").alias("__drop"))
    joined = documents.join(drops, row_key(id_col, text_col) == F.col("__key"), "left")
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, n: ~F.array_contains("__drop", n))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in documents.columns], F.coalesce(F.size("__drop"), F.lit(0)).alias("__dropped"))

"""From a located quote to places on pages: words with boxes, the rectangles that a quote covers, and an independent check of them.

Words are rows (doc_id, n, word, page, line, x0, y0, x1, y1), n in reading order; furniture is left out by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import skeleton

#: Fixed value: the share of an approximate anchor's words that its rectangles must hold.
COVERAGE = 0.8
SLACK = 0.5
#: Characters by which places and words meet.
STRETCH = 256
SPAN = ["item_id", "doc_id", "first", "last"]


def owned(words: DataFrame) -> DataFrame:
    """words with start and end: the characters of the document's skeleton, hyphens left out, that each word owns."""
    upto = F.sum(F.length(skeleton(F.col("word"), False))).over(Window.partitionBy("doc_id").orderBy("n"))
    return words.withColumn("end", upto).withColumn("start", F.col("end") - F.length(skeleton(F.col("word"), False)))


def word_texts(words: DataFrame) -> DataFrame:
    """(doc_id, text): the words of each document in order, as locate() reads them."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "word")))
    return words.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"))


def spans(found: DataFrame, words: DataFrame) -> DataFrame:
    """(item_id, doc_id, first, last): the words that found (item_id, doc_id, start, end), character places in the skeleton, touches; places that touch the same words are one.

    The words of the first and the last character are looked up by STRETCH, so that many places in a long document don't meet all of its words.
    """
    own = owned(words).select("doc_id", "n", F.col("start").alias("w_start"), F.col("end").alias("w_end")).where("w_end > w_start")
    own = own.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("w_start") / STRETCH), F.floor((F.col("w_end") - 1) / STRETCH))))
    ends = found.where("end > start").select("*", F.explode(F.array("start", F.col("end") - 1)).alias("at")).withColumn("stretch", F.floor(F.col("at") / STRETCH))
    hit = ends.join(own, ["doc_id", "stretch"]).where("w_start <= at AND at < w_end")
    return hit.groupBy("item_id", "doc_id", "start", "end").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("start", "end").distinct()


def _inside(word: str, rect: str) -> Column:
    middle = lambda a, b: (F.col(f"{word}{a}") + F.col(f"{word}{b}")) / 2
    within = lambda v, a, b: v.between(F.col(f"{rect}{a}") - SLACK, F.col(f"{rect}{b}") + SLACK)
    return within(middle("x0", "x1"), "x0", "x1") & within(middle("y0", "y1"), "y0", "y1")


def anchor(placed: DataFrame, words: DataFrame) -> DataFrame:
    """(item_id, doc_id, page, line, first, last, x0, y0, x1, y1, precision) of spans (item_id, doc_id, first, last): a rectangle for each line.

    It reaches from the first to the last word of the line, and vertically over the medians, so that
    one raised word does not swell it. An anchor is tight if none of its rectangles holds the middle
    of a word outside the span, else approximate.
    """
    covered = placed.join(words, "doc_id").where("n BETWEEN first AND last")
    rects = covered.groupBy(*SPAN, "page", "line").agg(F.min("x0").alias("x0"), F.median("y0").alias("y0"), F.max("x1").alias("x1"), F.median("y1").alias("y1"))
    others = words.select("doc_id", "page", "n", *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])
    boxes = rects.select(*SPAN, "page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    intruders = boxes.join(others, ["doc_id", "page"]).where((F.col("n") < F.col("first")) | (F.col("n") > F.col("last"))).where(_inside("w_", "r_"))
    loose = intruders.select(*SPAN).distinct().withColumn("loose", F.lit(True))
    precision = F.when(F.coalesce("loose", F.lit(False)), "approximate").otherwise("tight")
    return rects.join(loose, SPAN, "left").withColumn("precision", precision).drop("loose")


def roundtrip(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """(item_id, doc_id, ok, why) of each span: whether the rectangles of anchor() hold what they promise, read from the words alone.

    The middle of every word of the span lies in one of them, or, of an approximate anchor, of COVERAGE
    of the words; a tight one holds the middle of no other word.
    """
    one = anchors.groupBy(*SPAN).agg(F.max("precision").alias("precision"))
    boxes = anchors.select(*SPAN, "page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    read = words.select("doc_id", "page", "n", *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])
    held = boxes.join(read, ["doc_id", "page"]).where(_inside("w_", "r_")).select(*SPAN, "n").distinct()
    mine = F.col("n").between(F.col("first"), F.col("last"))
    counted = held.groupBy(*SPAN).agg(F.count_if(mine).alias("own"), F.count_if(~mine).alias("foreign"))
    wanted = one.join(words.select("doc_id", "n"), "doc_id").where("n BETWEEN first AND last").groupBy(*SPAN, "precision").agg(F.count(F.lit(1)).alias("size"))
    both = wanted.join(counted, SPAN, "left").fillna(0, ["own", "foreign"])
    tight = F.col("precision") == "tight"
    why = F.when(F.col("own") < F.when(tight, F.col("size")).otherwise(F.col("size") * COVERAGE), "a word lies outside").when(tight & (F.col("foreign") > 0), "a foreign word lies inside").otherwise("ok")
    return both.select("item_id", "doc_id", (why == "ok").alias("ok"), why.alias("why"))

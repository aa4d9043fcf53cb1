"""Words and rectangles on pages: (page, x0, y0, x1, y1) with y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _area(p: str) -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def _shared(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    return side("x0", "x1") * side("y0", "y1")


def _named(df: DataFrame, p: str) -> DataFrame:
    return df.select("page", *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != "page"])


def overlapping(boxes: DataFrame, least: float = 0.2) -> DataFrame:
    """(page, a, b, share): pairs of boxes (page, id, x0..y1) of a page that share more of the smaller one."""
    both = _named(boxes, "a_").join(_named(boxes, "b_"), "page").where("a_id < b_id AND a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    share = _shared("a_", "b_") / F.least(_area("a_"), _area("b_"))
    return both.withColumn("share", F.round(share, 6)).where(share > least).select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "share")


def words_in(rects: DataFrame, words: DataFrame, slack: float = 0.5) -> DataFrame:
    """(page, rect, word): words whose centre lies in a rectangle of their page."""
    x, y = (F.col("w_x0") + F.col("w_x1")) / 2, (F.col("w_y0") + F.col("w_y1")) / 2
    both = _named(rects, "r_").join(_named(words, "w_"), "page")
    return both.where(x.between(F.col("r_x0") - slack, F.col("r_x1") + slack) & y.between(F.col("r_y0") - slack, F.col("r_y1") + slack)).select("page", F.col("r_id").alias("rect"), F.col("w_id").alias("word"))


def best_reading(marks: DataFrame, rects: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, mark, reading, score): for each mark the reading whose rectangle it covers best, equal ones by id."""
    both = _named(marks, "m_").join(_named(rects, "r_"), "page").withColumn("score", F.round(_shared("m_", "r_") / F.least(_area("m_"), _area("r_")), 6)).where(F.col("score") >= least)
    return both.groupBy("page", F.col("m_id").alias("mark")).agg(F.max(F.struct("score", (-F.col("r_id")).alias("r"))).alias("s")).select("page", "mark", (-F.col("s.r")).alias("reading"), F.col("s.score").alias("score"))


def lines(words: DataFrame) -> DataFrame:
    """(page, line, x0, y0, x1, y1, words): the box of each line of words (page, line, ..)."""
    return words.groupBy("page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("words"))


def running_heads(texts: DataFrame, least: int = 3) -> DataFrame:
    """(text, pages): lines (page, text) that stand on several pages, digits taken as alike."""
    shape = F.regexp_replace(F.trim("text"), r"\d+", "#")
    return texts.groupBy(shape.alias("text")).agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)


def reading_order(marks: DataFrame) -> DataFrame:
    return marks.orderBy("page", "y0", "x0", "id")

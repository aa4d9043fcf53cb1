"""Tracing of stated numbers to table cells, and checks of tables against themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import tolerance


def trace(mentions: DataFrame, cells: DataFrame) -> DataFrame:
    """(paper, mention, status, cell) of every mention (paper, mention, value, decimals): the first cell of its paper with the same value is exact, else the first that rounds to it, else untraced.

    Cells (paper, cell, number) meet mentions by paper and by the whole part of the value and its neighbours, not one with every other.
    """
    near = mentions.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("value") - tolerance(F.col("decimals"))), F.floor("value"), F.floor(F.col("value") + tolerance(F.col("decimals")))))))
    placed = cells.select(F.col("paper"), "cell", "number", F.floor("number").alias("bin"))
    both = near.join(placed, ["paper", "bin"])
    gap = F.abs(F.col("number") - F.col("value"))
    tier = F.when(gap < 1e-9, 0).when(gap <= tolerance(F.col("decimals")) + 1e-9, 1)
    hits = both.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("paper", "mention").agg(F.min(F.struct("tier", "cell")).alias("best"))
    out = mentions.join(hits, ["paper", "mention"], "left")
    status = F.when(F.col("best.tier") == 0, "exact").when(F.col("best.tier") == 1, "rounded").otherwise("untraced")
    return out.select("paper", "mention", status.alias("status"), F.col("best.cell").alias("cell"))


def coverage(traces: DataFrame) -> DataFrame:
    """(paper, claims, supported, rate)."""
    supported = F.count_if(F.col("status") != "untraced")
    return traces.groupBy("paper").agg(F.count(F.lit(1)).alias("claims"), supported.alias("supported"), F.round(supported / F.count(F.lit(1)), 6).alias("rate"))


def main_table(traces: DataFrame) -> DataFrame:
    """(paper, cell, n): the cell that supports most mentions of a paper, the first of equals."""
    counts = traces.where("cell IS NOT NULL").groupBy("paper", "cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("paper").agg(F.max_by(F.struct("cell", "n"), F.struct(F.col("n"), -F.col("cell"))).alias("b")).select("paper", "b.*")


def total_mismatches(cells: DataFrame, kind: str = "sum") -> DataFrame:
    """(table, column, stated, expected): columns whose total row disagrees with its parts.

    Cells (table, row, column, value, decimals, is_total). The slack is the tolerance of the total
    and of all parts; a table speaks only if some column of two parts or more agrees.
    """
    parts = F.count_if(~F.col("is_total"))
    whole = F.sum(F.when(~F.col("is_total"), F.col("value")))
    slack = F.sum(F.when(~F.col("is_total"), tolerance(F.col("decimals"))))
    sums = cells.groupBy("table", "column").agg(parts.alias("n"), whole.alias("whole"), slack.alias("slack"), F.max(F.when(F.col("is_total"), F.col("value"))).alias("stated"), F.max(F.when(F.col("is_total"), tolerance(F.col("decimals")))).alias("own")).where("n >= 2 AND stated IS NOT NULL")
    n = F.lit(1) if kind == "sum" else F.col("n")
    judged = sums.withColumn("expected", F.col("whole") / n).withColumn("agrees", F.abs(F.col("whole") / n - F.col("stated")) <= F.col("own") + F.col("slack") / n + 1e-9)
    speaks = judged.where("agrees").select("table").distinct()
    return judged.where("NOT agrees").join(speaks, "table", "left_semi").select("table", "column", "stated", "expected")

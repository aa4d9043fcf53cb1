"""Views of a library of readings: search, titles, groups, totals. A reading is a row (paper, text, cue, about)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def readings(edges: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Edges and assumptions as one bag of readings with their kind."""
    return edges.withColumn("kind", F.lit("edge")).unionByName(assumptions.withColumn("kind", F.lit("assumption")), allowMissingColumns=True)


def search(rows: DataFrame, phrase: str, top: int = 40) -> DataFrame:
    """(tier, paper, text): readings that hold all words of the phrase, those that hold the phrase itself first, short texts before long ones, each text of a paper once. A phrase under two characters finds nothing."""
    phrase = " ".join(phrase.lower().split())
    if len(phrase) < 2:
        return rows.limit(0).select(F.lit(0).alias("tier"), "paper", "text")
    words = phrase.split()
    said, beside = F.lower("text"), F.lower(F.concat_ws(" ", "cue", "about"))
    every = lambda c: [c.contains(w) for w in words]
    hay = F.concat_ws(" ", said, beside)
    tier = F.when(said.contains(phrase), 0).when(beside.contains(phrase), 1)
    inside = every(said)[0]
    for c in every(said)[1:]:
        inside = inside & c
    found = rows
    for c in every(hay):
        found = found.where(c)
    ranked = found.withColumn("tier", F.coalesce(tier, F.when(inside, 2).otherwise(3)))
    once = ranked.groupBy("paper", "text").agg(F.min("tier").alias("tier"))
    return once.orderBy("tier", F.least(F.length("text"), F.lit(900)), "paper", "text").limit(top).select("tier", "paper", "text")


def first_matches(rows: DataFrame, needle: str, order: str, top: int = 20) -> DataFrame:
    """The first readings, in the order of the index, whose text, cue or subject hold the needle."""
    hay = F.lower(F.concat_ws(" ", "text", "cue", "about"))
    return rows.where(hay.contains(needle.lower())).orderBy(order).limit(top)


def attested(votes: DataFrame) -> DataFrame:
    """(id, title, votes) of (id, title): how many bibliographies tie each wording to an id."""
    return votes.groupBy("id", "title").agg(F.count(F.lit(1)).alias("votes"))


def chosen_titles(votes: DataFrame) -> DataFrame:
    """(id, title): votes pooled by folded title; in the largest pool the wording with most capitals, then votes, then the smallest."""
    counted = attested(votes).withColumn("folded", fold(F.col("title")))
    pools = counted.withColumn("pool", F.sum("votes").over(Window.partitionBy("id", "folded")))
    capitals = F.length(F.regexp_replace("title", "[^A-Z]", ""))
    best = Window.partitionBy("id").orderBy(F.desc("pool"), "folded", F.desc(capitals), F.desc("votes"), "title")
    return pools.withColumn("n", F.row_number().over(best)).where("n = 1").select("id", "title")


def unclaimed(titles: DataFrame) -> DataFrame:
    """Titles (id, title) whose folded form no other id has."""
    folded = titles.withColumn("folded", fold(F.col("title")))
    owners = folded.groupBy("folded").agg(F.count_distinct("id").alias("n")).where("n = 1").select("folded")
    return folded.join(owners, "folded", "left_semi").select("id", "title")


def grouped(papers: DataFrame, by: str) -> DataFrame:
    """(label, n): papers by category, none as 'uncategorised', the largest group first."""
    return papers.groupBy(F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("uncategorised")).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def top_with_totals(rows: DataFrame, by: str, top: int = 6) -> DataFrame:
    """(label, n, distinct, total, covered): the largest groups, how many groups and rows there are, and what share the shown ones hold."""
    counts = rows.groupBy(F.col(by).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
    shown = counts.orderBy(F.desc("n"), "label").limit(top)
    covered = F.round(F.sum("n").over(Window.partitionBy(F.lit(1))) / F.col("total"), 6)
    return shown.join(totals, F.lit(True)).withColumn("covered", covered)


def with_total(rows: DataFrame, paper: str, measures: dict[str, Column]) -> DataFrame:
    """Measures of each paper and of all together, whose paper is null."""
    return rows.rollup(paper).agg(*[m.alias(name) for name, m in measures.items()])

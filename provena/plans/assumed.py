"""Queries of assumptions in papers and of their cues' agreement with marked sentences, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assumptions
from .queries import ASSUMED, query, table

BARE = [s.removesuffix(".") for s in ASSUMED]


@query(f"""SELECT p_partkey AS paper, 1 AS section, ['stated', 'simplifying', NULL, NULL, 'conditional'][1 + p_size % 5] AS kind, {BARE}[1 + p_size % 5] || ' .' AS sentence,
 CASE p_size % 3 WHEN 0 THEN 'cited' WHEN 1 THEN 'shown' ELSE 'bare' END AS support, CASE WHEN p_size % 3 = 0 THEN 'a,b' ELSE '' END AS cites, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'sec,fig' ELSE 'sec' END AS refs FROM part WHERE p_size % 5 IN (0, 1, 4)""")
def cl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each part: one sentence in two sections, once with what backs it, a figure between them that states another."""
    size = F.col("p_size")
    said = F.element_at(F.array(*map(F.lit, BARE)), 1 + size % 5)
    behind = F.when(size % 3 == 0, " \\cite{a, b}").when(size % 3 == 1, " \\ref{sec,fig}").otherwise(" \\ref{sec}")
    source = F.concat(F.lit("\\newcommand{\\back}{"), behind, F.lit("}\n\\begin{document}\\section{Introduction}Nothing is said here. \\section{Method}"), said, F.lit("\\back. \\begin{figure}We assume that nothing of this figure is ever read as prose.\\end{figure} % We assume that comments are not read either here.\n"), F.lit("\\section{Results}"), said, F.lit("\\back. That is all.\\end{document}"))
    papers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"), source.alias("source"))
    labels = papers.select("paper", F.explode(F.array(F.struct(F.lit("fig").alias("label"), F.lit("figure").alias("kind")), F.struct(F.lit("sec").alias("label"), F.lit("section").alias("kind")))).alias("l")).select("paper", "l.*")
    found = assumptions.extract(papers, labels)
    return found.select("paper", "section", "kind", "sentence", "support", F.array_join("cites", ",").alias("cites"), F.array_join("refs", ",").alias("refs"))


MARKED = "s AS (SELECT p_brand AS corpus, p_size % 4 = 0 AS gold, p_size % 5 IN (0, 1, 4) AS flag, ['stated', 'simplifying', NULL, NULL, 'conditional'][1 + p_size % 5] AS kind FROM part)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ASSUMED)), 1 + F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("corpus"), said.alias("text"), (F.col("p_size") % 4 == 0).alias("uncertain"))


@query(f"""WITH {MARKED}, c AS (SELECT corpus, count(*) AS sentences, count(*) FILTER (WHERE gold) AS gold, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE gold AND flag) AS agreed FROM s GROUP BY 1),
w AS (SELECT *, agreed / flagged AS p, 1.96 AS z FROM c), i AS (SELECT *, (p + z * z / (2 * flagged)) / (1 + z * z / flagged) AS m, z / (1 + z * z / flagged) * sqrt(p * (1 - p) / flagged + z * z / (4 * flagged * flagged)) AS h FROM w)
SELECT corpus, sentences, gold, flagged, agreed, round(flagged / sentences, 6) AS coverage, round(coalesce(p, 0), 6) AS precision, CASE WHEN flagged = 0 THEN 0 ELSE round(greatest(0, m - h), 6) END AS low, CASE WHEN flagged = 0 THEN 0 ELSE round(least(1, m + h), 6) END AS high, round(coalesce(agreed / nullif(gold, 0), 0), 6) AS recall, round(coalesce(2 * agreed / nullif(flagged + gold, 0), 0), 6) AS f1 FROM i""")
def agg_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assumptions.agreement(_marked(spark, sf_dir))


@query(f"WITH {MARKED} SELECT corpus, kind, count(*) AS n FROM s WHERE kind IS NOT NULL GROUP BY 1, 2")
def hlp_hedge_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assumptions.kinds(_marked(spark, sf_dir))

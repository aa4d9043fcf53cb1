"""The lineage graph built anew only for papers whose sites changed, and whether sources and pages of papers belong together.

Sites are rows (paper, key, stance, ordinal, ..), as in lineage. A paper's state is a digest of all its
sites, which neither their order nor that of the files matters to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import skeleton
from .lineage import strongest
from .reading import mismatched

#: Fixed value: sentences of a paper that are sampled to see whether its source and its pages agree.
SAMPLE = 40


def states(sites: DataFrame) -> DataFrame:
    """(paper, state): two sums of 64-bit hashes of the paper's rows, each with the number of equal rows before it left out of account, as text."""
    row = [F.col(c) for c in sorted(sites.columns)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return sites.groupBy("paper").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("state"))


def build(sites: DataFrame) -> DataFrame:
    """The edges of all papers, the strongest site of each paper and key, with the state of their paper."""
    return strongest(sites).join(states(sites), "paper")


def rebuild(graph: DataFrame, sites: DataFrame) -> DataFrame:
    """build(sites), taking from graph, an earlier build, the edges of papers that have not changed; papers that are gone go."""
    now = states(sites)
    before = graph.select("paper", "state").distinct()
    same = now.join(before, ["paper", "state"], "left_semi")
    kept = graph.join(same.select("paper"), "paper", "left_semi")
    changed = now.join(same.select("paper"), "paper", "left_anti")
    fresh = strongest(sites.join(changed.select("paper"), "paper", "left_semi")).join(changed, "paper")
    return kept.unionByName(fresh.select(*kept.columns))


def sample(sentences: DataFrame, most: int = SAMPLE, seed: int = 7) -> DataFrame:
    """At most so many sentences (paper, n, text) of each paper, drawn by a digest of their place: reruns, and other engines, draw the same."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("paper").cast("string"), F.col("n").cast("string")))
    return sentences.withColumn("__place", F.row_number().over(Window.partitionBy("paper").orderBy(drawn, "n"))).where(F.col("__place") <= most).drop("__place")


def _stand(quotes: Column, text: Column) -> Column:
    """For each of the quotes, which are folded, whether it stands in the text."""
    folded = F.array(skeleton(F.coalesce(text, F.lit("")), False))  # a list of one, as a lambda would fold the text for each quote
    return F.get(F.transform(folded, lambda hay: F.transform(quotes, lambda quote: F.contains(hay, quote))), F.lit(0))


def alignment(sentences: DataFrame, pages: DataFrame, least: int = 16) -> DataFrame:
    """(paper, n, rate, mismatched) of papers with samples enough to judge: the share of their sampled sentences that stand on their pages (paper, text). Sentences under so many letters are not drawn."""
    drawn = sample(sentences.where(F.length(skeleton(F.col("text"), False)) >= least))
    # The few quotes of a paper meet its pages in one row, so that a text is sent and folded once for all of them.
    quotes = drawn.groupBy("paper").agg(F.collect_list(skeleton(F.col("text"), False)).alias("__quotes"))
    both = quotes.join(pages, "paper", "left").select("paper", F.explode(_stand(F.col("__quotes"), F.col("text"))).alias("__stands"))
    return mismatched(both, "paper", F.col("__stands"))

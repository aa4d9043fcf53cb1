"""What papers take for granted: every sentence that states an assumption, with the place of its cue and what backs it, and how far such cues agree with marked corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cues import read_assumption, support
from ..functions.numbers import wilson
from . import latex, markup

#: Environments whose content is no prose.
OPAQUE = (*latex.MATH, "tabular", "tabularx", "tabu", "table", "table*", "figure", "figure*", "verbatim", "lstlisting", "algorithm", "algorithmic", "thebibliography", "wrapfigure", "subfigure", "minipage", "picture", "tikzpicture")
#: Kinds of labels that show something.
SHOWN = ("table", "figure", "equation", "theorem", "algorithm")
REFERENCE = r"\\(?:eq|auto|c|C)?ref\*?\{([^}]*)\}"


def _names(raw: Column, pattern: str) -> Column:
    each = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), lambda group: F.split(group, ",")))
    return F.array_distinct(F.filter(F.transform(each, lambda k: F.trim(k)), lambda k: k != ""))


def extract(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """(paper, section, title, kind, cue, start, end, sentence, support, cites, refs): the assumptions of papers (paper, source); labels are (paper, label, kind).

    Read are the sections with the paper's macros expanded and without environments that hold no prose.
    A sentence that is stated again counts where it stands first. Start and end are the cue's
    characters in the sentence; an assumption is cited, shown by something it refers to, or bare.
    """
    clean = papers.withColumn("source", latex.without_comments(F.col("source")))
    prose = latex.without_environments(latex.expand_own_macros(clean), OPAQUE)
    each = markup.sections(prose).select("paper", "section", "title", F.col("kind").alias("section_kind"), F.posexplode(markup.sentences(F.col("text"))).alias("n", "raw"))
    read = each.withColumn("sentence", markup.plain_prose(F.regexp_replace("raw", REFERENCE, " "))).withColumn("found", read_assumption(F.col("sentence"))).where("found IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("paper", "sentence").orderBy("section", "n"))
    stated = read.withColumn("place", first).where("place = 1").withColumn("cites", _names(F.col("raw"), markup.CITE)).withColumn("refs", _names(F.col("raw"), REFERENCE))
    known = labels.where(F.col("kind").isin(*SHOWN)).groupBy("paper").agg(F.collect_set("label").alias("known"))
    backed = stated.join(known, "paper", "left")
    shown = F.coalesce(F.arrays_overlap("refs", "known"), F.lit(False))
    start = F.instr("sentence", F.col("found.cue")) - 1
    return backed.select("paper", "section", "title", "section_kind", "found.kind", "found.cue", start.alias("start"), (start + F.length("found.cue")).alias("end"), "sentence", support(F.size("cites") > 0, shown).alias("support"), "cites", "refs")


def agreement(sentences: DataFrame) -> DataFrame:
    """A row for each corpus of sentences (corpus, text, uncertain): how many are marked, flagged by a cue, and both; coverage, precision with its interval, recall and F1; zero where there is nothing to divide by."""
    read = sentences.select("corpus", F.coalesce("uncertain", F.lit(False)).alias("gold"), F.coalesce(read_assumption(F.col("text")).isNotNull(), F.lit(False)).alias("flag"))
    counts = read.groupBy("corpus").agg(F.count(F.lit(1)).alias("sentences"), F.count_if("gold").alias("gold"), F.count_if("flag").alias("flagged"), F.count_if(F.col("gold") & F.col("flag")).alias("agreed"))
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    both = F.col("flagged") + F.col("gold")
    interval = wilson(F.col("agreed"), F.col("flagged"))
    return counts.select("*", share("flagged", "sentences").alias("coverage"), share("agreed", "flagged").alias("precision"), interval["low"].alias("low"), interval["high"].alias("high"), share("agreed", "gold").alias("recall"), F.round(F.coalesce(2 * F.col("agreed") / F.nullif(both, F.lit(0)), F.lit(0.0)), 6).alias("f1"))


def kinds(sentences: DataFrame) -> DataFrame:
    """(corpus, kind, n): flagged sentences by the kind of assumption."""
    return sentences.select("corpus", read_assumption(F.col("text"))["kind"].alias("kind")).where("kind IS NOT NULL").groupBy("corpus", "kind").agg(F.count(F.lit(1)).alias("n"))

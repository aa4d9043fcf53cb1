"""Views of a library of papers: ids, titles, dates, totals, timelines, lookups and rectangles of marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers of papers: the new style of digits, the old one of an archive and seven digits; a version may follow.
NEW_ID, OLD_ID, VERSION = r"\d{4}\.\d{4,5}", r"[a-z-]+(?:\.[A-Z]{2})?/\d{7}", r"(?:v\d+)?"
#: The labels of two outside schemes that each stance stands for.
SCICITE = {"background": "background", "inherits": "method", "extends": "method", "contests": "result", "compares": "result"}
ACL_ARC = {"background": "Background", "inherits": "Uses", "extends": "Extends", "contests": "CompareOrContrast", "compares": "CompareOrContrast"}
SEVERITIES = ("error", "warning", "info")


def without_version(paper: Column) -> Column:
    return F.regexp_replace(paper, r"v\d+$", "")


def read_id(said: Column, keep_version: bool = False) -> Column:
    """The identifier that a text gives bare, with a scheme, or as an address; null if it gives none."""
    found = F.regexp_extract(F.trim(said), rf"^(?:https?://[^/]+/(?:abs|pdf)/|(?i:arxiv:)\s*)?((?:{NEW_ID}|{OLD_ID}){VERSION})(?:\.pdf)?$", 1)
    found = F.nullif(found, F.lit(""))
    return found if keep_version else without_version(found)


def clean_title(title: Column, passes: int = 4) -> Column:
    """The title without what reference lists put after it: years, preprint marks, bare identifiers and the like, taken off one by one where punctuation parts them from it."""
    tail = rf"(?:19|20)\d\d[a-z]?|{NEW_ID}{VERSION}|arxiv(?:\s+preprint)?(?:[:\s]\s*(?:arxiv:\s*)?{NEW_ID}{VERSION})?|preprint|in\s+press"
    for _ in range(passes):
        title = F.regexp_replace(title, rf"(?i)\s*[,.;:(\[]\s*(?:{tail})[\s.,;)\]]*$", "")
    return F.regexp_replace(title, r"^[\s,.;]+|[\s,.;]+$", "")


def mapped(stance: Column, labels: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), stance)


def totals(index: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of papers and the sum of each column, null as 0."""
    return index.agg(F.count(F.lit(1)).alias("papers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def by_year(papers: DataFrame, date: str) -> DataFrame:
    """(year, n, busiest): papers by year of publication; of the busiest years the first is marked."""
    counts = papers.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("top"))  # one row
    return counts.crossJoin(F.broadcast(top)).select("year", "n", (F.col("year") == F.col("top")).alias("busiest"))


def dated(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges (src, dst) with the years of both ends; those with an end that has none are left out."""
    years = papers.where("year IS NOT NULL")
    out = edges.join(years.select(F.col("id").alias("src"), F.col("year").alias("src_year")), "src")
    return out.join(years.select(F.col("id").alias("dst"), F.col("year").alias("dst_year")), "dst").select("src", "dst", "src_year", "dst_year")


def forward(edges: DataFrame) -> DataFrame:
    """(edges, forward): how many edges of dated() there are, and how many point to a newer paper."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("dst_year") > F.col("src_year")).alias("forward"))


def in_corpus(edges: DataFrame, papers: DataFrame, work: str = "key") -> DataFrame:
    """edges with __known: whether the work that each stands for is a paper (id) of the corpus."""
    known = papers.select(F.col("id").alias("__id")).distinct()
    return edges.join(known, F.col(work) == F.col("__id"), "left").withColumn("__known", F.col("__id").isNotNull()).drop("__id")


def titled(rows: DataFrame, titles: DataFrame, paper: str = "paper") -> DataFrame:
    """rows with the title (id, title) of their paper, its id where there is none."""
    named = titles.select(F.col("id").alias("__id"), F.col("title").alias("__title"))
    out = rows.join(named, F.col(paper) == F.col("__id"), "left")
    return out.withColumn("title", F.coalesce("__title", F.col(paper).cast("string"))).drop("__id", "__title")


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by order."""
    columns = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"first.{c}").alias(c) for c in columns])


def first_sources(rows: DataFrame, group: str, source: str, order: str, most: int = 12) -> DataFrame:
    """Rows of the first so many sources of each group, by the place where a source is met first."""
    met = rows.groupBy(group, source).agg(F.min(order).alias("__met"))
    ranked = met.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy("__met", source))).where(F.col("__rank") <= most)
    return rows.join(ranked.select(group, source), [group, source], "left_semi")


def retrieve(chunks: DataFrame, question: str, top: int = 45) -> DataFrame:
    """(id, score) of the texts (id, text) that answer best: a thousand for each word of the question that stands in them, less a tenth of their length."""
    terms = sorted({t for t in question.lower().split() if len(t) > 2})
    hits = sum((F.lower("text").contains(t).cast("int") for t in terms), F.lit(0))
    scored = chunks.withColumn("hits", hits).where("hits > 0")
    return scored.select("id", (F.col("hits") * 1000 - F.floor(F.length("text") / 10)).cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(top)


def best(rows: DataFrame, name: str, size: str) -> DataFrame:
    """One row: the name of the largest size, of equal ones the first."""
    return rows.groupBy().agg(F.max(size).alias(size), F.min_by(name, F.struct(-F.col(size), F.col(name))).alias(name)).where(F.col(name).isNotNull())


def half_even(value: Column, decimals: int) -> Column:
    """The value at so many places, halves to the even digit."""
    return F.bround(value, decimals)


def area(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    return (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))


def sane(rects: DataFrame) -> DataFrame:
    """Rectangles (x0, y0, x1, y1) whose sides are numbers in the right order."""
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in sides]
    out = rects
    for there in finite:
        out = out.where(there)
    return out.where("x1 > x0 AND y1 > y0")


def run_checks(paper: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]], only: list[str] | None = None) -> DataFrame:
    """Findings (severity, detail columns) of the named checks, each with its check_id and the rank of its severity; of no check, no rows without details."""
    found = None
    for name in sorted(checks if only is None else set(only) & set(checks)):
        one = checks[name](paper).withColumn("check_id", F.lit(name))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return paper.sparkSession.createDataFrame([], "severity string, check_id string, rank long")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    return found.withColumn("rank", F.when(rank == 0, F.lit(len(SEVERITIES) + 1)).otherwise(rank).cast("long"))


#: Kinds of sections that state a paper's claims, and the order in which support is shown.
HEADLINE, SUPPORT = ("abstract", "introduction", "conclusion"), ("bare", "cited", "shown")


def headline(sections: DataFrame) -> DataFrame:
    """Sections whose kind states the paper's claims."""
    return sections.where(F.col("kind").isin(*HEADLINE))


def inbound(edges: DataFrame, key: Column | int) -> DataFrame:
    """The edges that point to one work."""
    return edges.where(F.col("key") == key)


def support_rank(support: Column) -> Column:
    """The place of a support in the order bare, cited, shown; others come last."""
    place = F.array_position(F.array(*map(F.lit, SUPPORT)), support)
    return F.when(place > 0, place).otherwise(len(SUPPORT) + 1).cast("int")


def pool(cited: DataFrame, extras: DataFrame, key: str = "key") -> DataFrame:
    """(key, extra): cited works and extras, each once; extra marks those that nothing cites."""
    both = cited.select(key, F.lit(False).alias("extra")).unionByName(extras.select(key, F.lit(True).alias("extra")))
    return both.groupBy(key).agg(F.min("extra").alias("extra"))


def distinct_keys(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, keys): the keys of each group once each, by their first place."""
    first = rows.groupBy(group, key).agg(F.min(order).alias("__at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", key))), lambda x: x[key])
    return first.groupBy(group).agg(listed.alias("keys"))


def plain_decimal(value: Column) -> Column:
    """A decimal as text without trailing zeros or exponent; null stays null."""
    said = value.cast("string")
    return F.when(said.contains("."), F.regexp_replace(F.regexp_replace(said, "0+$", ""), r"\.$", "")).otherwise(said)

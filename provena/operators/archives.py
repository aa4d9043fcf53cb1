"""Papers as archives of files: the main file, the files that it includes, and which papers can be read. Files are rows (paper, path, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latex import document
from .markup import plain_prose, without_comments

INCLUDE = r"\\(?:input|include)\s*\{([^}]+)\}"
#: How deep files may include each other, and the characters of prose below which a source is a wrapper.
DEEPEST, LEAST_PROSE = 12, 1500
_INCLUDE = re.compile(INCLUDE, re.A)


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"^(?:\./)+", ""), r"\.tex$", "")


def main_files(files: DataFrame) -> DataFrame:
    """(paper, path): of the .tex files the one that declares a class and begins a document, else one that begins a document, else any; among equals one that no other file includes, then the largest, then the first by path."""
    text = F.coalesce("text", F.lit(""))
    begins = text.contains("\\begin{document}")
    leaf = lambda name: F.regexp_extract(_stem(name), r"([^/]*)$", 1)
    named = F.transform(F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(1)), leaf)
    # Only what is asked of a text leaves its row.
    sources = files.where(F.col("path").endswith(".tex")).select("paper", "path", leaf(F.col("path")).alias("leaf"), named.alias("named"), (begins & text.contains("\\documentclass")).alias("whole"), begins.alias("begins"), F.octet_length(text).alias("size"))
    papers = sources.groupBy("paper").agg(F.collect_list(F.struct("path", "leaf", "named", "whole", "begins", "size")).alias("files"))
    papers = papers.withColumn("included", F.flatten(F.transform("files", lambda f: f["named"])))
    rank = lambda f: F.struct((~f["whole"]).alias("a"), (~f["begins"]).alias("b"), (f["begins"] & F.array_contains("included", f["leaf"])).alias("c"), (-f["size"]).alias("d"), f["path"].alias("path"))
    return papers.select("paper", F.array_min(F.transform("files", rank))["path"].alias("path"))


def _stem_of(name: str) -> str:
    return re.sub(r"\.tex$", "", re.sub(r"^(?:\./)+", "", name.strip(" ")))


def put_together(main: str | None, files: list | None, deepest: int) -> str | None:
    """The text of the file at the path main with the files (path, text) that it includes in their places; null without it."""
    texts = {_stem_of(f["path"]): f["text"] for f in sorted(files or (), key=lambda f: f["path"])}
    if main is None or _stem_of(main) not in texts:
        return None
    seen = {_stem_of(main)}

    def place(stem: str, depth: int) -> str:
        out, at = [], 0
        for mark in _INCLUDE.finditer(texts[stem]):
            out.append(texts[stem][at : mark.start()])
            at, inner = mark.end(), _stem_of(mark[1])
            if inner in texts and inner not in seen:
                seen.add(inner)
                if depth < deepest:
                    out.append(place(inner, depth + 1))
        return "".join(out) + texts[stem][at:]

    return place(_stem_of(main), 0)


def _whole(files: DataFrame, mains: DataFrame) -> DataFrame:
    """(paper, source, wraps) of every paper, source null without a main file."""
    parts = files.select("paper", "path", without_comments(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("text", F.lit("")).contains("\\includepdf").alias("wraps"), F.lit(False).alias("main"))
    named = mains.select("paper", "path", F.lit("").alias("text"), F.lit(False).alias("wraps"), F.lit(True).alias("main"))
    each = parts.union(named).repartition("paper")  # first, so that no texts are gathered before they are sent
    papers = each.groupBy("paper").agg(F.collect_list(F.when(~F.col("main"), F.struct("path", "text", "wraps"))).alias("files"), F.max(F.when(F.col("main"), F.col("path"))).alias("main"))
    together = F.udf(put_together, "string", useArrow=True).asNondeterministic()
    wraps = F.exists("files", lambda f: f["wraps"] & (f["path"] == F.col("main")))
    return papers.select("paper", together("main", F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["text"].alias("text"))), F.lit(DEEPEST)).alias("source"), wraps.alias("wraps"))


def with_inputs(files: DataFrame, mains: DataFrame) -> DataFrame:
    """(paper, source) of mains (paper, path): the main file with the files that it includes in their places, comments dropped.

    A paper's files meet once, each sent once. A file stands at the first place that names it, in the
    order of reading; later places, places of files that aren't there and places inside the file itself
    stay empty. Files include each other DEEPEST levels down at most.
    """
    return _whole(files, mains).where("source IS NOT NULL").select("paper", "source")


def load(files: DataFrame) -> DataFrame:
    """(paper, source, prose_chars, reason): every paper with its source; reason says why it can't be read, null if it can."""
    whole = _whole(files, main_files(files)).withColumn("whole", F.col("source"))
    joined = document(whole).withColumn("prose_chars", F.length(plain_prose(F.col("source")))).withColumn("source", F.col("whole"))
    reason = F.when(F.col("source").isNull(), "no source").when(F.col("wraps"), "wraps a finished page").when(F.col("prose_chars") < LEAST_PROSE, "too little prose")
    return joined.select("paper", "source", F.coalesce("prose_chars", F.lit(0)).alias("prose_chars"), reason.alias("reason"))

"""Readers of labelled records, feeds and event logs. Malformed records are left out, not fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities, plain

LABEL = "paper STRING, key STRING, predicted STRING, sentence STRING, cue STRING, section STRING, gold STRING, note STRING, split STRING"
CITED = "string STRING, citeStart DOUBLE, citeEnd DOUBLE, label STRING"
MARKED = "cleaned_cite_text STRING, intent STRING"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSONL file; blank lines, comments and lines that are no record are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")


def labels(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, LABEL)


def cited_spans(records: DataFrame, known: list[str]) -> DataFrame:
    """(before, after, label) of records whose citation lies at given offsets; those out of range, without offsets or of an unknown label go."""
    start, end = F.col("citeStart"), F.col("citeEnd")
    good = records.where(F.col("label").isin(known) & ~F.isnan(start) & ~F.isnan(end) & (start >= 0) & (end >= start) & (end <= F.length("string")))
    return good.select(F.substring("string", F.lit(1), start.cast("int")).alias("before"), F.substring("string", end.cast("int") + 1, F.length("string")).alias("after"), "label")


def marked_spans(records: DataFrame, marker: str = "@@CITATION") -> DataFrame:
    """(before, after, label) of records with a marker at the citation."""
    at = F.instr("cleaned_cite_text", marker)
    good = records.where(at > 0)
    return good.select(F.substring("cleaned_cite_text", F.lit(1), at - 1).alias("before"), F.substring("cleaned_cite_text", at + len(marker), F.length("cleaned_cite_text")).alias("after"), F.col("intent").alias("label"))


def hedged_sentences(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """(text, uncertain) of sentences of 25 characters or more in a corpus with inline cues."""
    each = documents.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<sentence\b[^>]*>(.*?)</sentence>"), F.lit(1))).alias("s"))
    text = F.trim(F.regexp_replace(decode_entities(F.regexp_replace("s", r"<[^>]*>", "")), r"\s+", " "))
    return each.select(text.alias("text"), F.col("s").rlike(r'<cue\b[^>]*type="speculation"').alias("uncertain")).where(F.length("text") >= 25)


def _tag(item: Column, name: str) -> Column:
    return F.regexp_extract(item, rf"(?s)<{name}\b[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{name}>", 1)


def feed_items(feeds: DataFrame) -> DataFrame:
    """(source, title, link, summary, published) of the items of feeds (source, xml), RSS or Atom; an item without title or link goes."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<(item|entry)\b[^>]*>.*?</\1>"), F.lit(0))
    each = feeds.select("source", F.explode(items).alias("i"))
    link = F.coalesce(F.nullif(F.trim(_tag(F.col("i"), "link")), F.lit("")), F.regexp_extract("i", r'<link\b[^>]*href="([^"]*)"', 1))
    day = F.coalesce(F.try_to_timestamp(_tag(F.col("i"), "published")), F.try_to_timestamp(F.regexp_extract("i", r"(?s)<pubDate>\s*(?:\w{3},\s*)?(\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss")))
    rows = each.select("source", plain(decode_entities(_tag(F.col("i"), "title"))).alias("title"), decode_entities(link).alias("link"), plain(decode_entities(F.coalesce(F.nullif(_tag(F.col("i"), "description"), F.lit("")), _tag(F.col("i"), "summary")))).alias("summary"), day.alias("published"))
    return rows.where("title <> '' AND link <> ''")


def newest_first(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc_nulls_last("published"), "title")

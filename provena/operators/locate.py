"""Exact location of quotes in documents: the letters must agree, white space and the look of quotes and dashes may not matter.

All of it works on one index: a document's skeleton is cut into steps of STEP characters, and the GRAM
characters from each step on are hashed, with their place. A quote hashes the grams that begin at
its first (or last) STEP places; wherever it stands, exactly one of them begins at a step. So the
index meets the quotes by an equi-join on hashes, each occurrence once, and every meeting is held
against the text. Short rows of the index are exploded and shuffled, texts only for documents with a
meeting; a gram that many documents share is split by adaptive execution like any skewed key.

Defined results: null texts hold nothing; quotes under LEAST letters are never found; documents that
share an id, or have none, are searched each for itself and reported under that id, equal rows once;
without quotes or documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import skeleton
from ..sources.shared import staged

#: Least letters of a quote that can be located, and most occurrences that are counted.
LEAST, MOST = 16, 64
#: A part of a quote must have so many characters, and that share of the quote's.
LEAST_PART, LEAST_SHARE = 24, 0.4
#: Characters between indexed places, and of a gram; any LEAST characters hold a whole gram that begins at a step.
STEP = 5
GRAM = LEAST - STEP + 1


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def _skeletons(rows: DataFrame, keep_hyphens: bool) -> DataFrame:
    return rows.select("doc_id", "row", skeleton(F.coalesce("text", F.lit("")), keep_hyphens).alias("hay"))


def index(rows: DataFrame) -> DataFrame:
    """(row, at, gram) for rows (row, hay): the hash of the gram that begins at each step."""
    steps = rows.select("row", F.regexp_extract_all("hay", F.lit(rf"(?s).{{1,{STEP}}}"), F.lit(0)).alias("s"))
    whole, more = divmod(GRAM, STEP)
    ahead = lambda i, n: F.coalesce(F.get("s", i + n), F.lit(""))
    gram = lambda c, i: F.concat(c, *[ahead(i, n) for n in range(1, whole)], F.substring(ahead(i, whole), 1, more))
    grams = F.transform("s", lambda c, i: F.xxhash64(gram(c, i)))
    return steps.select("row", F.posexplode(grams).alias("n", "gram")).select("row", (F.col("n") * STEP).alias("at"), "gram")


def _seeds(quotes: DataFrame, ends: bool) -> DataFrame:
    """quotes (.., needle) with off and gram: the grams of the first STEP places; with ends those of the last ones too."""
    first = F.sequence(F.lit(0), F.lit(STEP - 1))
    last = F.transform(first, lambda n: F.length("needle") - LEAST + n)
    places = F.array_distinct(F.concat(first, last)) if ends else first
    return quotes.select("*", F.explode(places).alias("off")).withColumn("gram", F.xxhash64(F.substring(F.col("needle"), F.col("off") + 1, F.lit(GRAM))))


def _meetings(documents: DataFrame, quotes: DataFrame, keep_hyphens: bool, ends: bool = False) -> DataFrame:
    """quotes with doc_id, row, hay and start: every place at which a document may hold a quote, or, with ends, its beginning or its end."""
    rows = _rows(documents)
    seeds = _seeds(quotes.where(F.length("needle") >= LEAST), ends)
    met = index(_skeletons(rows, keep_hyphens)).join(seeds.withColumnRenamed("gram", "__gram"), F.col("gram") == F.col("__gram"))
    met = staged(met.withColumn("start", F.col("at") - F.col("off")).drop("gram", "__gram", "at", "off").distinct(), "locate-meetings")
    return met.join(_skeletons(rows.join(met.select("row"), "row", "left_semi"), keep_hyphens), "row")


def _same(of: Column, at: Column, needle: Column) -> Column:
    return F.substring(of, at + 1, F.length(needle)) == needle


def occurrences(documents: DataFrame, quotes: DataFrame, keep_hyphens: bool = True) -> DataFrame:
    """(item_id, doc_id, row, start) of every place of every quote (item_id, text), start in the skeleton."""
    wanted = quotes.select("item_id", skeleton(F.col("text"), keep_hyphens).alias("needle"))
    met = _meetings(documents, wanted, keep_hyphens)
    return met.where((F.col("start") >= 0) & _same(F.col("hay"), F.col("start"), F.col("needle"))).select("item_id", "doc_id", "row", "start").distinct()


def every_occurrence(documents: DataFrame, quotes: DataFrame, keep_hyphens: bool = True) -> DataFrame:
    """occurrences() with those of quotes under LEAST letters, of one at least: they meet the parts of their own lengths that begin at each place. Only where there are such quotes are texts read for them."""
    needle = skeleton(F.col("text"), keep_hyphens)
    short = staged(quotes.select("item_id", needle.alias("needle")).where(F.length("needle").between(1, LEAST - 1)), "locate-short")
    found = occurrences(documents, quotes, keep_hyphens)
    letters = _skeletons(_rows(documents), keep_hyphens).select("doc_id", "row", F.regexp_extract_all("hay", F.lit("(?s)."), F.lit(0)).alias("s"))

    def part(size: int) -> Column:
        return F.transform("s", lambda _, i: F.array_join(F.slice("s", i + 1, F.lit(size)), ""))

    for (size,) in short.select(F.length("needle")).distinct().collect():
        parts = letters.select("doc_id", "row", F.posexplode(part(size)).alias("start", "needle"))
        met = parts.join(short.where(F.length("needle") == size), "needle")
        found = found.union(met.select("item_id", "doc_id", "row", "start").distinct())
    return found


def locate(documents: DataFrame, quotes: DataFrame, keep_hyphens: bool = True) -> DataFrame:
    """(item_id, doc_id, occurrences, position) of every document (doc_id, text) that holds a quote (item_id, text); position of the first in the skeleton, occurrences may overlap and are counted up to MOST."""
    found = occurrences(documents, quotes, keep_hyphens).groupBy("item_id", "doc_id", "row").agg(F.least(F.count(F.lit(1)), F.lit(MOST)).cast("long").alias("occurrences"), F.min("start").cast("long").alias("position"))
    return found.drop("row")


def locate_either(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """locate() with how: strict where the hyphens agree as well, loose for quotes that no document holds strictly."""
    strict = staged(locate(documents, quotes), "locate-strict")
    rest = quotes.join(strict.select("item_id").distinct(), "item_id", "left_anti")
    return strict.withColumn("how", F.lit("strict")).union(locate(documents, rest, False).withColumn("how", F.lit("loose")))


def locate_longest(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id, part, side, start): of every document and quote the longest beginning or end, in whole words, that the document holds.

    A part counts from LEAST_PART characters and LEAST_SHARE of the quote on; of an equally long
    beginning and end the beginning, of several places the first. Hyphens don't matter.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    skeletons = F.transform(words, lambda w: skeleton(w, False))
    wanted = quotes.select("item_id", F.array_join(words, " ").alias("quote"), words.alias("words"), skeletons.alias("skeletons"), F.array_join(skeletons, "").alias("needle"))
    met = _meetings(documents, wanted, False, ends=True)
    upto = F.transform("skeletons", lambda w, i: F.length(F.array_join(F.slice("skeletons", F.lit(1), i + 1), "")))
    met = met.withColumn("upto", upto).withColumn("size", F.length("needle"))
    begins = F.size(F.filter("upto", lambda n: (F.col("start") >= 0) & (F.substring(F.col("hay"), F.col("start") + 1, n) == F.substring(F.col("needle"), F.lit(1), n))))
    rest = lambda n: F.col("size") - n
    ends = F.size(F.filter("upto", lambda n: (F.col("start") + n >= 0) & (rest(n) > 0) & (F.substring(F.col("hay"), F.col("start") + n + 1, rest(n)) == F.substring(F.col("needle"), n + 1, rest(n))))) + F.when((F.col("start") >= 0) & _same(F.col("hay"), F.col("start"), F.col("needle")), 1).otherwise(0)
    head, tail = F.array_join(F.slice("words", F.lit(1), F.col("begins")), " "), F.array_join(F.slice("words", F.size("words") - F.col("ends") + 1, F.col("ends")), " ")
    each = met.withColumn("begins", begins).withColumn("ends", ends)
    skipped = F.when(F.size("words") > F.col("ends"), F.get("upto", F.size("words") - F.col("ends") - 1)).otherwise(0)
    sides = F.array(F.struct(head.alias("part"), F.lit("beginning").alias("side"), F.col("start").alias("start")), F.struct(tail.alias("part"), F.lit("end").alias("side"), (F.col("start") + skipped).alias("start")))
    parts = each.select("item_id", "doc_id", "row", "quote", F.explode(sides).alias("p")).select("item_id", "doc_id", "row", "quote", "p.*")
    sound = parts.where((F.length("part") >= LEAST_PART) & (F.length("part") >= LEAST_SHARE * F.length("quote")))
    order = Window.partitionBy("item_id", "doc_id", "row").orderBy(F.desc(F.length("part")), "side", "start")
    return sound.withColumn("place", F.row_number().over(order)).where("place = 1").select("item_id", "doc_id", "part", "side", F.col("start").cast("long").alias("start"))


def on_page(pages: DataFrame, wanted: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, page, start) of wanted (item_id, page, text) that stand exactly once on their page (page, text), however short; hyphens don't matter."""
    needle, hay = skeleton(F.col("needle"), False), skeleton(F.coalesce("text", F.lit("")), False)
    both = wanted.select("item_id", "page", F.col("text").alias("needle")).join(pages.select("page", "text"), "page").select("item_id", "page", needle.alias("needle"), hay.alias("hay")).where(F.length("needle") >= least)
    first = F.call_function("locate", F.col("needle"), F.col("hay"), F.lit(1))
    again = F.call_function("locate", F.col("needle"), F.col("hay"), F.col("first") + 1)
    return both.withColumn("first", first).where((F.col("first") > 0) & (again == 0)).select("item_id", "page", (F.col("first") - 1).cast("long").alias("start"))


def unique(found: DataFrame) -> DataFrame:
    """Quotes that occur once in one document only, with their place."""
    counted = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("occurrences").alias("n"), F.min("doc_id").alias("doc_id"), F.min("position").alias("position"))
    return counted.where("documents = 1 AND n = 1").select("item_id", "doc_id", "position")

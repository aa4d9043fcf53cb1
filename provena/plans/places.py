"""Queries of quotes and their places over documents, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, locate
from ..sources.shared import staged
from .queries import query, table

BARE = "regexp_replace(translate(lower({}), '‘’“”–—‐‑', '''''\"\"----'), '[\\s ­​-]+', '', 'g')"
WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"


def _altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with words put before, behind or in place of their own, so that only a part of each stands anywhere."""
    item, text = F.col("item_id"), F.col("text")
    said = F.when(item % 4 == 0, F.concat(text, F.lit(" zqx wvu"))).when(item % 4 == 1, F.concat(F.lit("Zqx wvu "), text)).when(item % 4 == 2, F.concat(F.substring(text, 1, 60), F.lit(" zqx "), F.substring(text, 61, 1000))).otherwise(F.reverse(text))
    return table(spark, sf_dir, "benchmark").select("item_id", said.alias("text"))


ALTERED = "CASE item_id % 4 WHEN 0 THEN text || ' zqx wvu' WHEN 1 THEN 'Zqx wvu ' || text WHEN 2 THEN substr(text, 1, 60) || ' zqx ' || substr(text, 61, 1000) ELSE reverse(text) END"


@query(f"""WITH d AS (SELECT doc_id, {BARE.format('text')} AS h FROM documents),
q AS (SELECT item_id, {WORDS.format(ALTERED)} AS w FROM benchmark),
p AS (SELECT item_id, array_to_string(w, ' ') AS quote, side, CASE side WHEN 0 THEN array_to_string(w[1:k], ' ') ELSE array_to_string(w[len(w) - k + 1:], ' ') END AS part FROM q, unnest(range(1, len(w) + 1)) AS u(k), (VALUES (0), (1)) s(side)),
s AS (SELECT *, {BARE.format('part')} AS n FROM p WHERE length(part) >= 24 AND length(part) >= 0.4 * length(quote)),
f AS (SELECT item_id, doc_id, part, side, instr(h, n) - 1 AS start FROM s JOIN d ON contains(h, n))
SELECT item_id, doc_id, part, CASE side WHEN 0 THEN 'beginning' ELSE 'end' END AS side, start FROM f QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY length(part) DESC, side) = 1""")
def loc_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate_longest(table(spark, sf_dir, "documents"), _altered(spark, sf_dir))


def _hyphened(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 20), F.lit("-"), F.substring("text", 21, 2000)))
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))


@query(f"""WITH d AS (SELECT doc_id, {BARE.format('text')} AS h, {BARE.format('text').replace('-]+', ']+')} AS s FROM documents),
q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE substr(text, 1, 20) || '-' || substr(text, 21, 2000) END AS t FROM benchmark), n AS (SELECT item_id, {BARE.format('t')} AS l, {BARE.format('t').replace('-]+', ']+')} AS k FROM q),
a AS (SELECT item_id, doc_id, instr(s, k) - 1 AS position, 'strict' AS how FROM n JOIN d ON contains(s, k))
SELECT * FROM a UNION ALL SELECT item_id, doc_id, instr(h, l) - 1, 'loose' FROM n JOIN d ON contains(h, l) WHERE item_id NOT IN (SELECT item_id FROM a)""")
def loc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate_either(table(spark, sf_dir, "documents"), _hyphened(spark, sf_dir)).drop("occurrences")


@query(f"""WITH p AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents), g AS (SELECT doc_id * 1000 + k AS page, w[k * 50 + 1:k * 50 + 50] AS w FROM p, unnest(range((len(w) + 49) // 50)) AS u(k)),
a AS (SELECT page, {BARE.format("array_to_string(w, '')")} AS h, {BARE.format("w[2] || coalesce(w[3], '')")} AS n FROM g WHERE len(w) > 1)
SELECT page AS item_id, page, instr(h, n) - 1 AS start FROM a WHERE length(n) >= 2 AND instr(substr(h, instr(h, n) + 1), n) = 0""")
def loc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    each = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    numbers = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 50).cast("int"))
    parts = F.transform(numbers, lambda k: F.slice("w", k * 50 + 1, F.lit(50)))  # cut before they are rows, so that no row has all words
    pages = each.select("doc_id", F.posexplode(parts).alias("k", "w")).select((F.col("doc_id") * 1000 + F.col("k")).alias("page"), "w")
    wanted = pages.where(F.size("w") > 1).select(F.col("page").alias("item_id"), "page", F.concat(F.get("w", F.lit(1)), F.lit(" "), F.coalesce(F.get("w", F.lit(2)), F.lit(""))).alias("text"))
    return locate.on_page(pages.select("page", F.array_join("w", " ").alias("text")), wanted)


def _words(documents: DataFrame) -> DataFrame:
    """The words of documents set in lines of ten and pages of forty lines, each word ten wide; in every third line the last word stands a line lower."""
    each = documents.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("n", "word"))
    line, column = F.floor(F.col("n") / 10), F.col("n") % 10
    low = (line % 3 == 2) & (column == 9)
    y = (line % 40) * 12.0 + F.when(low, 12.0).otherwise(0.0)
    x = F.when(low, 0.0).otherwise(column * 10.0)
    return each.select("doc_id", F.col("n").cast("long").alias("n"), "word", F.floor(line / 40).alias("page"), line.alias("line"), x.alias("x0"), y.alias("y0"), (x + 9.0).alias("x1"), (y + 10.0).alias("y1"))


SET = f"""w AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS word FROM (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS l FROM documents)),
g AS (SELECT *, n // 400 AS page, n // 10 AS line, (n // 10) % 3 = 2 AND n % 10 = 9 AS low, length({BARE.format('word')}) AS size, coalesce(sum(length({BARE.format('word')})) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM w),
x AS (SELECT *, CAST(CASE WHEN low THEN 0 ELSE n % 10 * 10 END AS DOUBLE) AS x0, CAST(line % 40 * 12 + CASE WHEN low THEN 12 ELSE 0 END AS DOUBLE) AS y0 FROM g),
d AS (SELECT doc_id, {BARE.format('text')} AS h FROM documents), q AS (SELECT item_id, {BARE.format('text')} AS k FROM benchmark),
f AS (SELECT item_id, doc_id, instr(h, k) - 1 AS s, instr(h, k) - 1 + length(k) AS e FROM q JOIN d ON contains(h, k)),
t AS (SELECT item_id, f.doc_id, min(n) AS first, max(n) AS last FROM f JOIN x ON x.doc_id = f.doc_id AND a + size > s AND a < e GROUP BY 1, 2),
r AS (SELECT item_id, t.doc_id, page, line, first, last, min(x0) AS x0, median(y0) AS y0, max(x0) + 9 AS x1, median(y0) + 10 AS y1 FROM t JOIN x ON x.doc_id = t.doc_id AND n BETWEEN first AND last GROUP BY ALL),
o AS (SELECT DISTINCT item_id, r.doc_id FROM r JOIN x ON x.doc_id = r.doc_id AND x.page = r.page AND n NOT BETWEEN first AND last AND x.x0 + 4.5 BETWEEN r.x0 - 0.5 AND r.x1 + 0.5 AND x.y0 + 5 BETWEEN r.y0 - 0.5 AND r.y1 + 0.5)"""

# The same with every place of a quote in a document, not its first alone; places that touch the same words are one.
SET_EVERY = SET.replace(
    "f AS (SELECT item_id, doc_id, instr(h, k) - 1 AS s, instr(h, k) - 1 + length(k) AS e FROM q JOIN d ON contains(h, k))",
    "z AS (SELECT item_id, doc_id, h, k, instr(h, k) - 1 AS s FROM q JOIN d ON contains(h, k) WHERE k <> '' UNION ALL SELECT item_id, doc_id, h, k, s + instr(substr(h, s + 2), k) FROM z WHERE contains(substr(h, s + 2), k)),\nf AS (SELECT item_id, doc_id, s, s + length(k) AS e FROM z)",
).replace("t AS (SELECT item_id, f.doc_id, min(n) AS first, max(n) AS last FROM f JOIN x ON x.doc_id = f.doc_id AND a + size > s AND a < e GROUP BY 1, 2)", "t AS (SELECT DISTINCT item_id, doc_id, first, last FROM (SELECT item_id, f.doc_id, s, min(n) AS first, max(n) AS last FROM f JOIN x ON x.doc_id = f.doc_id AND a + size > s AND a < e GROUP BY ALL))").replace("SELECT DISTINCT item_id, r.doc_id FROM r", "SELECT DISTINCT item_id, r.doc_id, first, last FROM r")


def _anchored(spark: SparkSession, sf_dir: str, every: bool = False):
    documents, quotes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = locate.every_occurrence(documents, quotes, False).withColumnRenamed("start", "position") if every else locate.locate(documents, quotes, False)
    found = staged(found.select("item_id", "doc_id", "position").distinct(), "anchors-found")
    # Only documents that hold a quote are set in words, and once for all steps.
    words = staged(_words(documents.join(found.select("doc_id"), "doc_id", "left_semi")), "anchors-words")
    sizes = quotes.select("item_id", F.length(locate.skeleton(F.col("text"), False)).alias("size"))
    placed = found.join(sizes, "item_id").select("item_id", "doc_id", F.col("position").alias("start"), (F.col("position") + F.col("size")).alias("end"))
    placed = anchors.spans(placed, words)
    if not every:
        placed = placed.groupBy("item_id", "doc_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    placed = staged(placed, "anchors-placed")
    return anchors.anchor(placed, words), words


@query(f"WITH RECURSIVE {SET_EVERY} SELECT r.*, CASE WHEN o.item_id IS NULL THEN 'tight' ELSE 'approximate' END AS precision FROM r LEFT JOIN o ON o.item_id = r.item_id AND o.doc_id = r.doc_id AND o.first = r.first AND o.last = r.last")
def loc_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir, every=True)[0]


@query(f"""WITH {SET}, i AS (SELECT DISTINCT r.item_id, r.doc_id, n, n BETWEEN first AND last AS mine FROM r JOIN x ON x.doc_id = r.doc_id AND x.page = r.page AND x.x0 + 4.5 BETWEEN r.x0 - 0.5 AND r.x1 + 0.5 AND x.y0 + 5 BETWEEN r.y0 - 0.5 AND r.y1 + 0.5),
c AS (SELECT item_id, doc_id, count(*) FILTER (WHERE mine) AS own, count(*) FILTER (WHERE NOT mine) AS others FROM i GROUP BY 1, 2),
j AS (SELECT c.*, last - first + 1 AS size, o.item_id IS NULL AS tight FROM c JOIN t ON t.item_id = c.item_id AND t.doc_id = c.doc_id LEFT JOIN o ON o.item_id = c.item_id AND o.doc_id = c.doc_id),
y AS (SELECT item_id, doc_id, CASE WHEN own < CASE WHEN tight THEN size ELSE size * 0.8 END THEN 'a word lies outside' WHEN tight AND others > 0 THEN 'a foreign word lies inside' ELSE 'ok' END AS why FROM j)
SELECT item_id, doc_id, why = 'ok' AS ok, why FROM y""")
def loc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, words = _anchored(spark, sf_dir)
    return anchors.roundtrip(staged(found, "anchors-rectangles"), words)

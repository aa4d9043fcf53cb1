"""Queries of layouts, inferred sections, incremental builds and alignment, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, layout, markup
from .queries import LINKS, _links, query, table


@query("""WITH s AS (SELECT l_orderkey AS paper, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS section, ['abstract', 'introduction', 'other', 'other', 'experiments', 'other', 'related'][1 + l_partkey % 7] AS kind FROM lineitem),
e AS (SELECT *, min(section) FILTER (WHERE kind = 'experiments') OVER (PARTITION BY paper) AS e FROM s),
f AS (SELECT *, max(section) FILTER (WHERE kind IN ('abstract', 'introduction', 'related') AND (e IS NULL OR section < e)) OVER (PARTITION BY paper) AS f FROM e)
SELECT paper, section, CASE WHEN kind = 'other' AND section > f AND (e IS NULL OR section < e) THEN 'method' ELSE kind END AS kind FROM f""")
def win_infermethod(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kinds = F.array(*map(F.lit, ["abstract", "introduction", "other", "other", "experiments", "other", "related"]))
    typed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.row_number().over(order).cast("long").alias("section"), F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int")).alias("kind"))
    return markup.infer_method(typed)


@query("""WITH p AS (SELECT l_orderkey AS paper, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, ['As shown by Smith et al.', 'We use the following:', 'It ends here.', 'See Fig.', 'By J.'][1 + l_partkey % 5] AS piece FROM lineitem),
f AS (SELECT *, lag(piece) OVER w AS b, lag(i // 3) OVER w = i // 3 AS same FROM p WINDOW w AS (PARTITION BY paper ORDER BY i)),
n AS (SELECT *, sum(CASE WHEN coalesce(CASE WHEN same THEN b LIKE '%al.' OR b LIKE '%Fig.' OR b LIKE '%J.' ELSE b LIKE '%:' END, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY paper ORDER BY i) AS n FROM f)
SELECT paper, n::BIGINT AS n, string_agg(piece, ' ' ORDER BY i) AS sentence FROM n GROUP BY 1, 2""")
def win_rowsmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    said = F.array(*map(F.lit, ["As shown by Smith et al.", "We use the following:", "It ends here.", "See Fig.", "By J."]))
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), i.alias("i"), F.element_at(said, (F.col("l_partkey") % 5 + 1).cast("int")).alias("piece"))
    return markup.merge_sentences(pieces.select("paper", F.floor(F.col("i") / 3).alias("block"), (F.col("i") % 3).alias("n"), "piece"))


TITLES = {"Related Work and Results": "related", "Approach and limitations": "limitations", "Summary of our method": "conclusion", "Model evaluation": "experiments", "Model comparison": "results", "A unified framework": "method", "Introduction": "introduction", "Deep Learning": "other"}


@query(f"SELECT p_partkey, {list(TITLES.values())}[1 + p_size % {len(TITLES)}] AS kind FROM part")
def fn_section_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, TITLES)), F.col("p_size") % len(TITLES) + 1)
    return table(spark, sf_dir, "part").select("p_partkey", markup.kind_of(title).alias("kind"))


@query("WITH p AS (SELECT o_custkey AS view, o_orderkey AS id, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS x FROM orders), w AS (SELECT view, count(*) OVER (PARTITION BY view ORDER BY x RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) AS n FROM p) SELECT view, count(*) AS papers, max(n) AS lanes FROM w GROUP BY 1")
def win_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders on a timeline of days, labels 200 days wide: as many lanes as labels ever overlap."""
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    placed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("view"), F.col("o_orderkey").alias("id"), days.alias("x"))
    return layout.lanes(placed, 200).groupBy("view").agg(F.count(F.lit(1)).alias("papers"), (F.max("lane") + 1).cast("long").alias("lanes"))


@query("""WITH w AS (SELECT l_orderkey AS mark, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_quantity AS q FROM lineitem),
r AS (SELECT mark, i // 3 AS line, i % 3 * 20.0 + CASE WHEN i % 3 = 2 THEN 30.0 ELSE 0.0 END AS x0, i FROM w), b AS (SELECT mark, line, x0 >= 60 AS far, min(x0) AS x0, max(x0) + 15 AS x1 FROM r GROUP BY ALL)
SELECT mark, row_number() OVER (PARTITION BY mark ORDER BY line, x0) - 1 AS n, CAST(x0 AS DOUBLE) AS x0, CAST(line * 12 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(line * 12 + 10 AS DOUBLE) AS y1 FROM b""")
def win_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an order's lines, three to a line of the page, the third far from the others; one of them twice and a flat one."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mark"), i.alias("i"))
    x, y = F.col("i") % 3 * 20.0 + F.when(F.col("i") % 3 == 2, 30.0).otherwise(0.0), F.floor(F.col("i") / 3) * 12.0
    boxes = words.select("mark", "i", x.alias("x0"), y.alias("y0"), (x + 15).alias("x1"), (y + 10).alias("y1"))
    flat = boxes.where("i = 1").withColumn("y1", F.col("y0"))
    found = layout.condense(boxes.union(boxes.where("i = 2")).union(flat).drop("i"))
    return found.withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {LINKS}, d AS (SELECT n AS id, count(*) AS degree FROM (SELECT src AS n FROM links UNION ALL SELECT dst FROM links) GROUP BY 1), t AS (SELECT * FROM d ORDER BY degree DESC, id LIMIT 20),
o AS (SELECT id, row_number() OVER (ORDER BY p_size, id) - 1 AS i, count(*) OVER () AS n FROM t JOIN part ON p_partkey = id)
SELECT id, 96 + i / greatest(1, n - 1) * 748.0::DOUBLE AS x, (52 + i % greatest(3, least(9, ceil(n / 4)))::BIGINT * 76)::BIGINT AS y, i % 2 = 0 AS above, (SELECT count(*) FROM d) - n AS hidden FROM o""")
def win_rank_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("date"))
    return layout.ranked(_links(spark, sf_dir), dates)


def _sites(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """The line items as sites; before the change, orders of some customers lacked their returned items and others had more."""
    stance = F.element_at(F.array(*map(F.lit, ["contests", "extends", "inherits", "compares", "background"])), (F.col("l_linenumber") % 5 + 1))
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), (F.col("l_suppkey") % 7).alias("key"), stance.alias("stance"), F.col("l_linenumber").alias("ordinal"), "l_returnflag")
    return sites.drop("l_returnflag") if late else sites.where("l_returnflag <> 'R' OR paper % 3 > 0").drop("l_returnflag")


@query("""WITH s AS (SELECT l_orderkey AS paper, l_suppkey % 7 AS key, 1 + l_linenumber % 5 AS r, l_linenumber AS ordinal FROM lineitem)
SELECT paper, key, ['contests', 'extends', 'inherits', 'compares', 'background'][min(r)] AS stance, arg_min(ordinal, (r, ordinal)) AS ordinal FROM s GROUP BY 1, 2""")
def gr_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph built before a third of the papers changed, and built on: the same as built whole."""
    graph = build.build(_sites(spark, sf_dir, late=False))
    return build.rebuild(graph, _sites(spark, sf_dir, late=True)).drop("state")


PIECES = """s AS (SELECT doc_id AS paper, unnest(range(len(l))) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), '.') AS l FROM documents)),
b AS (SELECT *, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​-]+', '', 'g') AS q FROM s),
d AS (SELECT * FROM b WHERE length(q) >= 16 QUALIFY row_number() OVER (PARTITION BY paper ORDER BY md5('7:' || paper || ':' || n), n) <= 40)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\.")).alias("n", "text"))


@query(f"WITH {PIECES} SELECT paper, n, text FROM d")
def loc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir).where(F.length(build.skeleton(F.col("text"), False)) >= 16)
    return build.sample(pieces).select("paper", F.col("n").cast("long").alias("n"), "text")


@query(f"""WITH {PIECES}, p AS (SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 ELSE doc_id END AS paper, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​-]+', '', 'g') AS h FROM documents WHERE doc_id % 4 <> 1),
j AS (SELECT d.paper, coalesce(contains(h, q), FALSE) AS ok FROM d LEFT JOIN p ON p.paper = d.paper) SELECT paper, count(*) AS n, count(*) FILTER (WHERE ok) / count(*) AS rate, count(*) FILTER (WHERE ok) / count(*) < 0.25 AS mismatched FROM j GROUP BY 1 HAVING count(*) >= 10""")
def join_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth paper has the pages of the one before it, and that one has none."""
    swapped = table(spark, sf_dir, "documents").where("doc_id % 4 <> 1").select(F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("paper"), "text")
    return build.alignment(_pieces(spark, sf_dir), swapped)


@query(f"""WITH {PIECES}, p AS (SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 ELSE doc_id END AS paper, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​-]+', '', 'g') AS h FROM documents WHERE doc_id % 4 <> 1),
j AS (SELECT d.paper, coalesce(contains(h, q), FALSE) AS ok FROM d LEFT JOIN p ON p.paper = d.paper) SELECT paper FROM j GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (WHERE ok) / count(*) < 0.25""")
def chk_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_alignment(spark, sf_dir).where("mismatched").select("paper")

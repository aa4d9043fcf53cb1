"""Queries of the library views over the tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup, views
from .queries import BOXES, LINKS, SITES, _boxes, _links, _papers, _sites, query, table

PART_IDS = "CASE p_size % 5 WHEN 0 THEN 'https://host.org/abs/' || n || 'v2' WHEN 1 THEN 'arXiv:' || n WHEN 2 THEN 'math.GT/030' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || 'v1' WHEN 3 THEN 'see ' || n ELSE 'https://host.org/pdf/' || n || '.pdf' END"
NUMBERED = "p AS (SELECT *, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '.1234' || p_size % 10 AS n FROM part)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    number = F.concat(four, F.lit(".1234"), (F.col("p_size") % 10).cast("string"))
    forms = [F.concat(F.lit("https://host.org/abs/"), number, F.lit("v2")), F.concat(F.lit("arXiv:"), number), F.concat(F.lit("math.GT/030"), four, F.lit("v1")), F.concat(F.lit("see "), number), F.concat(F.lit("https://host.org/pdf/"), number, F.lit(".pdf"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*forms), F.col("p_size") % 5).alias("said"))


@query(f"WITH {NUMBERED} SELECT p_partkey, CASE p_size % 5 WHEN 2 THEN 'math.GT/030' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 3 THEN NULL ELSE n END AS id FROM p")
def src_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("p_partkey", views.read_id(F.col("said")).alias("id"))


@query(f"WITH {NUMBERED} SELECT p_partkey, regexp_replace({PART_IDS}, 'v[0-9]+$', '') AS id FROM p")
def hlp_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("p_partkey", views.without_version(F.col("said")).alias("id"))


@query("SELECT p_partkey, p_name || CASE p_size % 9 WHEN 4 THEN ' 2001' ELSE '' END AS title FROM part")
def fn_cleantitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [", 2019.", ". arXiv preprint arXiv:1901.01234v2, 2019", " (preprint)", "", " 2001", ", 2017, 1706.03741", ", in press", "; 1999a. ,", " [arXiv:1706.03741]"]
    said = F.concat("p_name", F.get(F.array(*map(F.lit, ends)), F.col("p_size") % 9))
    return table(spark, sf_dir, "part").select("p_partkey", views.clean_title(said).alias("title"))


@query(f"WITH {SITES} SELECT ordinal, stance, CASE stance WHEN 'background' THEN 'background' WHEN 'inherits' THEN 'method' WHEN 'extends' THEN 'method' ELSE 'result' END AS scicite, CASE stance WHEN 'background' THEN 'Background' WHEN 'inherits' THEN 'Uses' WHEN 'extends' THEN 'Extends' ELSE 'CompareOrContrast' END AS acl_arc FROM sites")
def cl_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    stance = F.col("stance")
    return _sites(spark, sf_dir).select("ordinal", "stance", views.mapped(stance, views.SCICITE).alias("scicite"), views.mapped(stance, views.ACL_ARC).alias("acl_arc"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY 1) SELECT count(*) AS papers, coalesce(sum(lines), 0)::BIGINT AS lines, coalesce(sum(quantity), 0)::BIGINT AS quantity FROM orders LEFT JOIN l ON l_orderkey = o_orderkey")
def agg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return views.totals(table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left"), "lines", "quantity")


@query("WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1) SELECT year, n, year = (SELECT year FROM c ORDER BY n DESC, year LIMIT 1) AS busiest FROM c")
def ui_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.by_year(table(spark, sf_dir, "orders"), "o_orderdate")


DATED = f"{LINKS}, y AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN 1990 + p_size % 30 END AS year FROM part), d AS (SELECT src, dst, a.year AS src_year, b.year AS dst_year FROM links JOIN y a ON a.id = src JOIN y b ON b.id = dst WHERE src <> dst AND a.year IS NOT NULL AND b.year IS NOT NULL)"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 > 0, 1990 + F.col("p_size") % 30).alias("year"))
    return views.dated(_links(spark, sf_dir), years)


@query(f"WITH {DATED} SELECT * FROM d")
def join_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir)


@query(f"WITH {DATED} SELECT count(*) AS edges, count(*) FILTER (WHERE dst_year > src_year) AS forward FROM d")
def gr_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forward(_dated(spark, sf_dir))


@query(f"WITH {SITES} SELECT ordinal, key, key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) AS known FROM sites")
def join_in_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("id"))
    return views.in_corpus(_sites(spark, sf_dir), papers).select("ordinal", "key", F.col("__known").alias("known"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN p_size % 5 > 0 THEN p_name END, CAST(l_partkey AS VARCHAR)) AS title FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def join_library_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").where("p_size % 5 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return views.titled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), titles, "l_partkey")


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def win_firstseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.first_seen(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


@query(f"WITH {SITES}, m AS (SELECT paper, key, min(ordinal) AS met FROM sites GROUP BY 1, 2), r AS (SELECT paper, key FROM m QUALIFY row_number() OVER (PARTITION BY paper ORDER BY met, key) <= 12) SELECT paper, key, ordinal FROM sites JOIN r USING (paper, key)")
def win_dense_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.first_sources(_sites(spark, sf_dir).select("paper", "key", "ordinal"), "paper", "key", "ordinal")


@query("WITH h AS (SELECT item_id AS id, text, contains(lower(text), 'the')::INT + contains(lower(text), 'ing')::INT + contains(lower(text), 'ent')::INT AS hits FROM benchmark) SELECT id, hits * 1000 - CAST(floor(length(text) / 10) AS BIGINT) AS score FROM h WHERE hits > 0 ORDER BY score DESC, id LIMIT 45")
def top_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.retrieve(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), "the ing ent of")


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, n FROM c ORDER BY n DESC, p_type LIMIT 1")
def agg_best_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.best(table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type", "n")


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM c")
def num_roundlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = (F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (views.half_even(exact, 1) * 10).cast("long").alias("tenths"))


@query(f"WITH {BOXES} SELECT page, id, (x1 - x0) * (y1 - y0) AS area FROM b WHERE id % 5 > 0")
def flt_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    broken = F.col("id") % 5 == 0  # turned round, or without a side
    turned = boxes.withColumn("x1", F.when(broken, F.when(F.col("id") % 2 == 0, F.col("x0") - 1)).otherwise(F.col("x1")))
    return views.sane(turned).select("page", "id", views.area().alias("area"))


@query("SELECT regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^(www|m)\\.', '') AS source, count(*) AS n, count(*) FILTER (WHERE contains(url, '?')) AS shown FROM pages GROUP BY 1")
def flt_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1), r"^(?:www|m)\.", "")
    return table(spark, sf_dir, "pages").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").contains("?")).alias("shown"))


@query("""WITH f AS (SELECT 'discount' AS check_id, CASE WHEN l_discount >= 0.09 THEN 'error' ELSE 'warning' END AS severity, l_orderkey AS paper, l_linenumber AS line FROM lineitem WHERE l_discount >= 0.08
UNION ALL SELECT 'quantity', 'info', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49)
SELECT *, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END::BIGINT AS rank FROM f""")
def agg_registry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = [F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line")]
    checks = {
        "quantity": lambda lines: lines.where("l_quantity >= 49").select(F.lit("info").alias("severity"), *place),
        "discount": lambda lines: lines.where("l_discount >= 0.08D").select(F.when(F.col("l_discount") >= 0.09, "error").otherwise("warning").alias("severity"), *place),
    }
    return views.run_checks(table(spark, sf_dir, "lineitem"), checks)


@query("SELECT p_partkey, p_name AS title FROM part ORDER BY lower(p_name), p_partkey")
def top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title")).orderBy(F.lower("title"), "p_partkey")


@query("SELECT o.o_orderkey AS paper, k.kind FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) o CROSS JOIN (VALUES ('abstract'), ('introduction')) k(kind)")
def flt_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.headline(markup.sections(_papers(spark, sf_dir))).select("paper", "kind")


@query(f"WITH {SITES}, m AS (SELECT min(key) AS k FROM sites) SELECT paper, key, ordinal, stance FROM sites, m WHERE key = k")
def join_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return views.inbound(sites, sites.agg(F.min("key").alias("k")).first()["k"]).select("paper", "key", "ordinal", "stance")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS place FROM part")
def top_bare_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = F.get(F.array(*map(F.lit, ("bare", "cited", "shown", "unread"))), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", views.support_rank(support).alias("place")).orderBy("place", "p_partkey")


@query("SELECT p_partkey AS key, p_partkey NOT IN (SELECT l_partkey FROM lineitem) AS extra FROM part UNION SELECT l_partkey, false FROM lineitem")
def set_union_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pool(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))


@query(f"WITH {SITES}, m AS (SELECT paper, key, min(ordinal) AS met FROM sites GROUP BY 1, 2) SELECT paper, string_agg(CAST(key AS VARCHAR), ',' ORDER BY met, key) AS keys FROM m GROUP BY 1")
def set_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.distinct_keys(_sites(spark, sf_dir), "paper", "key", "ordinal")
    return out.select("paper", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("WITH c AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part) SELECT p_partkey, CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) WHEN c % 10 = 0 THEN (c // 100) || '.' || (c // 10) % 10 ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS said FROM c")
def num_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.round(F.col("p_retailprice"), 2).cast("decimal(20,6)")
    return table(spark, sf_dir, "part").select("p_partkey", views.plain_decimal(exact).alias("said"))


@query(f"WITH {BOXES} SELECT page, id, (x1 - x0) * (y1 - y0) AS area FROM b")
def hlp_rectarea(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("page", "id", views.area().alias("area"))

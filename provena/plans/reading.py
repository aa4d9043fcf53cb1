"""Queries of the rules about numbers and readings over the tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reading
from .queries import CLAIMS, _traces, query, table

BEFORE = "CASE p_size % 5 WHEN 0 THEN 'of at  least ' WHEN 1 THEN 'is Better than ' WHEN 2 THEN 'moreover ' WHEN 3 THEN 'with ≥' ELSE 'reaches ' END"


@query(f"SELECT p_partkey, {BEFORE} AS said FROM part WHERE p_size % 5 IN (0, 1, 3)")
def flt_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(BEFORE).alias("said"))
    return parts.where(reading.is_bound(F.col("said")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN FALSE WHEN l_returnflag = 'N' THEN TRUE ELSE l_linestatus = 'F' OR l_linenumber % 2 > 0 END AS claim FROM lineitem")
def flt_claimlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "layers").when(F.col("l_returnflag") == "N", "BLEU")
    claim = reading.is_claim_like(unit, F.col("l_linestatus") == "F", F.col("l_linenumber") % 2, ["layers", "heads"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", claim.alias("claim"))


@query(f"WITH {CLAIMS} SELECT * FROM traces WHERE status <> 'untraced'")
def flt_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).where(reading.is_supported(F.col("status")))


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber <= 2) / count(*) AS rate, count(*) FILTER (WHERE l_linenumber <= 2) / count(*) < 0.25 AS mismatched FROM lineitem GROUP BY 1 HAVING count(*) >= 10")
def flt_decidable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.mismatched(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_linenumber") <= 2)


@query("SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) IS NULL AS last FROM lineitem")
def win_lineend(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return reading.line_ends(words, ["l_orderkey"], "l_linenumber")


@query("""WITH f AS (SELECT l_orderkey AS key, l_linestatus AS value FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_linestatus DESC) = 1)
SELECT o_orderkey AS key, coalesce(f.value, o_orderstatus) AS value, f.key IS NULL AS stale FROM orders LEFT JOIN f ON f.key = o_orderkey""")
def join_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    fresh = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("value"), "l_linenumber")
    return reading.refresh(labels, fresh, ["key"], "value", "l_linenumber")


@query("SELECT count(*) AS labels, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS stale FROM orders")
def join_refresh_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.refreshed(join_refresh(spark, sf_dir))


@query("WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey % 100 AS title, p_size FROM part) SELECT id, title FROM t WHERE NOT EXISTS (SELECT 1 FROM t q WHERE q.p_size > 25 AND q.title = t.title AND q.id <> t.id)")
def join_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 100).cast("string")).alias("title"), "p_size")
    attested = titles.where("p_size > 25").withColumn("title", F.concat(F.upper("title"), F.lit(".")))
    return reading.unclaimed(titles.drop("p_size"), attested)


@query("SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT) + l_linenumber)::BIGINT AS items FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT) + l_linenumber) < 40")
def agg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return reading.thin(lines, "l_orderkey", ["quantity", "l_linenumber"], 40)


@query("SELECT l_orderkey, l_linenumber, 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS at FROM lineitem")
def st_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return reading.placed(batches, "l_orderkey", "l_linenumber", F.lit(1000))

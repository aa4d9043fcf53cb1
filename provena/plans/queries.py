"""Queries of the engine's own operators over the tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cues, numbers, text
from ..operators import evaluate, findings, geometry, library, lineage, locate, markup, sessions, trace
from ..sources import records
from ..streaming import events as stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
STAGES = ["view", "click", "purchase"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Event streams

STEPS = "steps AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session, ts AS t, event_id AS seq, event_type AS name FROM events)"


@query(f"""WITH {STEPS},
a AS (SELECT session, min((t, seq)) AS p FROM steps WHERE name = 'view' GROUP BY 1),
b AS (SELECT s.session, min((t, seq)) AS p FROM steps s JOIN a ON a.session = s.session AND (s.t, s.seq) > a.p WHERE name = 'click' GROUP BY 1),
c AS (SELECT s.session, min((t, seq)) AS p FROM steps s JOIN b ON b.session = s.session AND (s.t, s.seq) > b.p WHERE name = 'purchase' GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM a) x, (SELECT count(*) FROM b) y, (SELECT count(*) FROM c) z)
SELECT 1 AS stage_no, 'view' AS stage, x AS reached, round(x / nullif(x, 0), 6) AS share FROM n UNION ALL
SELECT 2, 'click', y, round(y / nullif(x, 0), 6) FROM n UNION ALL SELECT 3, 'purchase', z, round(z / nullif(x, 0), 6) FROM n""")
def agg_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.funnel(sessions.steps_of(table(spark, sf_dir, "events")), STAGES)


@query(f"WITH {STEPS} SELECT session, min(t) AS start, max(t) AS \"end\", count(*) AS steps, CAST(round((epoch_us(max(t)) - epoch_us(min(t))) / 1000000) AS BIGINT) AS seconds FROM steps GROUP BY 1")
def agg_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(sessions.steps_of(table(spark, sf_dir, "events")))


@query(f"""WITH {STEPS}, l AS (SELECT *, lag(name) OVER (PARTITION BY session ORDER BY t, seq) AS before FROM steps),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS n FROM l WHERE before IS NULL OR before <> name),
p AS (SELECT session, string_agg(name, ' → ' ORDER BY n) AS path FROM r WHERE n <= 3 GROUP BY 1)
SELECT path, count(*) AS sessions FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def agg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.common_paths(sessions.steps_of(table(spark, sf_dir, "events")))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS bucket, count(*) AS events FROM events GROUP BY 1, 2")
def agg_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.daily(table(spark, sf_dir, "events"))


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS people FROM events GROUP BY 1")
def agg_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.uniques(table(spark, sf_dir, "events"))


@query()
def agg_uniques_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sketched_uniques(table(spark, sf_dir, "events")).drop("sketch")


@query("SELECT event_type AS bucket, count(*)::BIGINT AS events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def agg_merge12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.merge_top(sessions.daily(table(spark, sf_dir, "events")))


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY 1")
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b FROM events)
SELECT user_id, event_type, count(*) FILTER (WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) >= 60000000) AS visits, max(ts) AS last FROM l GROUP BY 1, 2""")
def win_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.debounced(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("SELECT event_id, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) <= 20")
def st_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.newest_of_day(table(spark, sf_dir, "events"), 20).select("event_id", "ts", "user_id")


@query("SELECT event_id, event_type, substr(trim(regexp_replace(coalesce(props, ''), '[^A-Za-z0-9 ._/-]', '', 'g')), 1, 60) AS label FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def flt_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.accepted(table(spark, sf_dir, "events"), STAGES).select("event_id", "event_type", "label")


VISITS = "SELECT user_id AS id, count(*) AS visits, max(event_type) AS title, max(ts) AS seen FROM events WHERE event_id % 2 = {} GROUP BY 1"


def _visits(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_id") % 2 == half).groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("visits"), F.max("event_type").alias("title"), F.max("ts").alias("seen"))


@query(f"WITH b AS ({VISITS.format(0)} UNION ALL {VISITS.format(1)}) SELECT id, max(visits) AS visits, arg_max(title, (seen, title)) AS title, max(seen) AS seen FROM b GROUP BY 1 ORDER BY seen DESC, id LIMIT 200")
def join_historymerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.merge_visits(_visits(spark, sf_dir, 0), _visits(spark, sf_dir, 1))


@query("WITH v AS (SELECT user_id AS id, count(*) AS visits, min(ts) AS seen FROM events GROUP BY 1) SELECT count(*) AS papers, sum(visits)::BIGINT AS opens, min(seen) AS since FROM v")
def agg_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("visits"), F.min("ts").alias("seen"))
    return sessions.visit_summary(visits)


# Citation lineage: a customer's orders cite suppliers; the line number stands for the stance of a site.

SITES = """sites AS (SELECT o_custkey AS paper, l_suppkey AS key, ['contests', 'extends', 'inherits', 'compares', 'background'][1 + l_linenumber % 5] AS stance,
l_orderkey * 100 + l_linenumber AS ordinal, CAST(l_quantity AS INTEGER) % 5 AS weight, l_suppkey % 2 = 0 AS in_corpus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES = f"""{SITES}, edges AS (SELECT * FROM sites QUALIFY row_number() OVER (PARTITION BY paper, key ORDER BY list_position(['contests', 'extends', 'inherits', 'compares', 'background'], stance), ordinal, weight, in_corpus) = 1)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stance = F.element_at(F.array(*map(F.lit, lineage.STANCES)), 1 + F.col("l_linenumber") % 5)
    return lines.select(F.col("o_custkey").alias("paper"), F.col("l_suppkey").alias("key"), stance.alias("stance"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_quantity").cast("int") % 5).alias("weight"), (F.col("l_suppkey") % 2 == 0).alias("in_corpus"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.strongest(_sites(spark, sf_dir))


@query(f"WITH {EDGES} SELECT * FROM edges")
def agg_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH {EDGES} SELECT paper, key, stance, weight, in_corpus, ordinal FROM edges WHERE stance IN ('inherits', 'extends') QUALIFY row_number() OVER (PARTITION BY paper ORDER BY weight, stance <> 'inherits', NOT in_corpus, ordinal, key) = 1")
def agg_foundation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.foundation(_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT paper, {', '.join(f'''count(*) FILTER (WHERE stance = '{s}') AS {s}''' for s in lineage.STANCES)}, count(*) FILTER (WHERE stance <> 'background' AND in_corpus) AS walkable FROM edges GROUP BY 1")
def agg_lineage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tally(_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT key, count(DISTINCT paper) AS papers FROM edges WHERE stance IN ('inherits', 'extends') GROUP BY 1 HAVING count(DISTINCT paper) > 1 ORDER BY 2 DESC, 1 LIMIT 8")
def agg_foundations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.foundations(_edges(spark, sf_dir))


@query(f"WITH {SITES} SELECT key, count(DISTINCT paper) AS cited, count(*) FILTER (WHERE stance <> 'background') AS stanced FROM sites WHERE key NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) GROUP BY 1")
def agg_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("id"))
    return lineage.survey(_sites(spark, sf_dir), have)


@query(f"WITH {SITES} SELECT key, count(DISTINCT paper) AS cited, count(*) FILTER (WHERE stance <> 'background') AS stanced FROM sites WHERE key NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) GROUP BY 1 ORDER BY stanced DESC, cited DESC, key LIMIT 40")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.candidates(agg_survey(spark, sf_dir))


@query(f"WITH {EDGES}, c AS (SELECT stance, count(*) AS n FROM edges GROUP BY 1) SELECT stance, n, CAST(floor(100 * n / (SELECT sum(n) FROM c) + 0.5) AS BIGINT) AS percent FROM c")
def agg_stance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.stance_share(_edges(spark, sf_dir))


@query(f"WITH {EDGES}, t AS (SELECT paper, weight, key, min(ordinal) AS o FROM edges WHERE stance = 'contests' GROUP BY ALL) SELECT paper, CAST(weight AS VARCHAR) AS text, string_agg(CAST(key AS VARCHAR), ',' ORDER BY o, key) AS targets FROM t GROUP BY 1, 2")
def agg_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.contested(_edges(spark, sf_dir).withColumn("text", F.col("weight").cast("string")))


@query("SELECT lower(trim(p_type)) AS cue, count(*) AS n FROM part GROUP BY 1")
def agg_bycue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.by_cue(table(spark, sf_dir, "part"), "p_type")


#: Two papers: the sites of light weight, and those of heavy weight.
PAIR = f"""WITH {SITES},
x AS (SELECT key, bool_or(stance IN ('inherits', 'extends')) AS l, bool_or(stance IN ('contests', 'compares')) AS p FROM sites WHERE weight < 2 GROUP BY 1),
y AS (SELECT key, bool_or(stance IN ('inherits', 'extends')) AS l, bool_or(stance IN ('contests', 'compares')) AS p FROM sites WHERE weight >= 2 GROUP BY 1)
SELECT key, CASE WHEN (x.l AND y.p AND NOT y.l) OR (y.l AND x.p AND NOT x.l) THEN 'part ways' WHEN x.l AND y.l THEN 'both stand on' WHEN x.p AND y.p THEN 'both push' ELSE 'both cite' END AS bucket FROM x JOIN y USING (key)"""


@query(PAIR)
def gr_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return lineage.compare(sites.where("weight < 2"), sites.where("weight >= 2"))


# A sparse graph: each part cites the part that lies its size ahead.

LINKS = "links AS (SELECT p_partkey AS src, p_partkey + p_size AS dst FROM part WHERE p_partkey + p_size <= (SELECT max(p_partkey) FROM part))"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst"))
    return lineage.cross_edges(part, part.select(F.col("src").alias("id")))


@query(f"WITH {LINKS} SELECT src, dst FROM links WHERE src <> dst")
def join_cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(f"WITH {LINKS}, e AS (SELECT src AS n FROM links UNION ALL SELECT dst FROM links) SELECT n AS node, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def agg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.degree(_links(spark, sf_dir))


WALK = f"""WITH RECURSIVE {LINKS}, e AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
walk AS (SELECT 1::BIGINT AS node, 0 AS hops, [1::BIGINT] AS path UNION ALL SELECT dst, hops + 1, list_append(path, dst::BIGINT) FROM walk JOIN e ON node = src WHERE hops < 4)"""


@query(f"{WALK} SELECT node, min(hops) AS hops FROM walk GROUP BY 1")
def gr_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.reachable(_links(spark, sf_dir), 1)


@query(f"{WALK} SELECT node, hops, array_to_string(path, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY hops, path) = 1")
def gr_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.connect(_links(spark, sf_dir), 1)


@query("""SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_totalprice >= 100000 THEN 'new' ELSE 'old' END AS state FROM orders""")
def snk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    old, new = orders.where("price < 200000 OR price IS NULL"), orders.where("price >= 100000")  # both hold the rows between
    return lineage.upsert(old.withColumn("state", F.lit("old")), new.withColumn("state", F.lit("new")))


@query("""WITH c AS (SELECT l_orderkey AS r, l_linenumber % 4 AS c, max(CAST(l_partkey AS VARCHAR)) AS raw FROM lineitem GROUP BY 1, 2)
SELECT r AS "row", coalesce(max(raw) FILTER (WHERE c = 0), '') || '|' || coalesce(max(raw) FILTER (WHERE c = 1), '') || '|' || coalesce(max(raw) FILTER (WHERE c = 2), '') || '|' || coalesce(max(raw) FILTER (WHERE c = 3), '') AS cells FROM c GROUP BY 1""")
def snk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row"), (F.col("l_linenumber") % 4).alias("column")).agg(F.max(F.col("l_partkey").cast("string")).alias("raw"))
    return lineage.dense_grid(cells, 4).select("row", F.array_join("cells", "|").alias("cells"))


# Text

MARKS = f"'{text.MARKED}', '{text.PLAIN}'"


@query(f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), {MARKS}), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents")
def fn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query("""SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM part""")
def fn_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = text.digest(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.conv(digest, 36, 10).cast("long").alias("h"))


@query("SELECT s_suppkey, substr(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM supplier")
def fn_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.slug(F.col("s_name")).alias("slug"))


_DECODED = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g')"
for _name, _character in text.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_name}', '{_character.replace(chr(39), chr(39) * 2)}')"


@query(f"WITH t AS (SELECT page_id, trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 320 THEN rtrim(substr(t, 1, 319)) || '…' ELSE t END AS plain FROM t")
def fn_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


@query("""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS h FROM pages)
SELECT page_id, CASE WHEN h = '' OR h IS NULL THEN 'direct' ELSE h END AS host FROM h""")
def fn_refhost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.referrer_host(F.col("url")).alias("host"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query(f"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')), lambda w: NOT list_contains({_STOP}, w)))::BIGINT AS n FROM documents")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.terms(F.col("text"))).cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN length(trim(split_part(p_name, ':', 1))) <= 26 THEN trim(split_part(p_name, ':', 1)) ELSE rtrim(substr(trim(split_part(p_name, ':', 1)), 1, 25)) || '…' END AS short FROM part")
def prj_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.shorten(F.col("p_name")).alias("short"))


@query("SELECT item_id FROM benchmark WHERE length(text) >= 12 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 2 >= length(text) AND NOT regexp_matches(text, '(?i)https?:|www\\.|doi\\.org')")
def flt_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where(text.plausible_title(F.col("text"))).select("item_id")


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)^\\s*(who|what|when|where|which|why|how)\\b') OR suffix(trim(text), '?') OR len(regexp_split_to_array(trim(text), '\\s+')) >= 6")
def flt_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(text.is_question(F.col("text"))).select("conv_id", "turn")


@query("SELECT event_id, substr(sha256(CAST(CAST(ts AS DATE) AS VARCHAR) || ':secret:' || CAST(user_id AS VARCHAR) || ':' || event_type), 1, 20) AS mark FROM events")
def fn_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = text.visitor(F.to_date("ts").cast("string"), "secret", F.col("user_id").cast("string"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", mark.alias("mark"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​]+', '', 'g') AS h FROM documents),
q AS (SELECT item_id, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​]+', '', 'g') AS n FROM benchmark)
SELECT item_id, doc_id, (length(h) - length(replace(h, n, ''))) // length(n) AS occurrences, instr(h, n) - 1 AS position FROM q JOIN d ON contains(h, n) WHERE length(n) >= 16""")
def loc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​]+', '', 'g') AS h FROM documents),
q AS (SELECT item_id, regexp_replace(translate(lower(text), '‘’“”–—‐‑', '''''""----'), '[\\s ­​]+', '', 'g') AS n FROM benchmark),
f AS (SELECT item_id, doc_id, (length(h) - length(replace(h, n, ''))) // length(n) AS c, instr(h, n) - 1 AS p FROM q JOIN d ON contains(h, n) WHERE length(n) >= 16)
SELECT item_id, min(doc_id) AS doc_id, min(p) AS position FROM f GROUP BY 1 HAVING count(*) = 1 AND sum(c) = 1""")
def loc_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.unique(loc_exact(spark, sf_dir))


# Numbers, traces and checks. Statements are written from lineitem's values, read back, and held against them.


@query("""SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS INTEGER) AS percent, CAST(l_quantity AS INTEGER) AS quantity, 3::BIGINT AS found FROM lineitem""")
def num_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("In 2019 it gained %d%% over %d,000 of GPT-3 units, or %dM", F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.find_numbers(said).alias("f"))
    return found.select("l_orderkey", "l_linenumber", F.get("f", F.lit(0))["value"].cast("int").alias("percent"), (F.get("f", F.lit(1))["value"] / 1000).cast("int").alias("quantity"), F.size("f").cast("long").alias("found"))


@query("SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_size % 2 = 0 AS decorated FROM part")
def num_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.format_string("%.2f", F.col("p_retailprice"))
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\\textbf{"), raw, F.lit("}*"))).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.cell_number(cell)["value"] * 100).cast("long").alias("cents"), (F.col("p_size") % 2 == 0).alias("decorated"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE abs(l_extendedprice - (round(l_extendedprice, 0) + l_linenumber % 2)) <= 0.5 + 1e-12""")
def join_roundsto(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = F.round("l_extendedprice", 0) + F.col("l_linenumber") % 2
    return table(spark, sf_dir, "lineitem").where(numbers.rounds_to(F.col("l_extendedprice"), reported, F.lit(0))).select("l_orderkey", "l_linenumber", "l_extendedprice")


CLAIMS = """cells AS (SELECT l_orderkey AS paper, l_linenumber AS cell, l_extendedprice / 1000 AS number FROM lineitem),
mentions AS (SELECT l_orderkey AS paper, l_linenumber AS mention, CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice / 1000 WHEN 1 THEN round(l_extendedprice / 1000, 1) ELSE -1.0 END AS value, CASE l_linenumber % 3 WHEN 0 THEN 6 ELSE 1 END AS decimals FROM lineitem),
hits AS (SELECT m.paper, mention, CASE WHEN abs(number - value) < 1e-9 THEN 0 ELSE 1 END AS tier, cell FROM mentions m JOIN cells c ON m.paper = c.paper AND abs(number - value) <= 0.5 * pow(10.0, -decimals) + 1e-9),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY paper, mention ORDER BY tier, cell) = 1),
traces AS (SELECT m.paper, m.mention, CASE b.tier WHEN 0 THEN 'exact' WHEN 1 THEN 'rounded' ELSE 'untraced' END AS status, b.cell FROM mentions m LEFT JOIN best b ON m.paper = b.paper AND m.mention = b.mention)"""


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    price, kind = F.col("l_extendedprice") / 1000, F.col("l_linenumber") % 3
    cells = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("cell"), price.alias("number"))
    mentions = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("mention"), F.when(kind == 0, price).when(kind == 1, F.round(price, 1)).otherwise(F.lit(-1.0)).alias("value"), F.when(kind == 0, 6).otherwise(1).alias("decimals"))
    return trace.trace(mentions, cells)


@query(f"WITH {CLAIMS} SELECT * FROM traces")
def join_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir)


@query(f"WITH {CLAIMS} SELECT paper, count(*) AS claims, count(*) FILTER (WHERE status <> 'untraced') AS supported, round(count(*) FILTER (WHERE status <> 'untraced') / count(*), 6) AS rate FROM traces GROUP BY 1")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.coverage(_traces(spark, sf_dir))


@query(f"WITH {CLAIMS}, n AS (SELECT paper, cell, count(*) AS n FROM traces WHERE cell IS NOT NULL GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY paper ORDER BY n DESC, cell) = 1")
def agg_main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.main_table(_traces(spark, sf_dir))


@query("""WITH p AS (SELECT o_custkey AS t, o_orderkey, round(o_totalprice / 1000, 1) AS v FROM orders), s AS (SELECT t, count(*) AS n, sum(v) AS w FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT t AS "table", 1 AS "column", round(w + 10, 1) AS stated, round(w, 1) AS expected FROM s WHERE t % 4 = 0 AND n * 0.05 + 0.05 < 9.9""")
def agg_total_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders are a table of two equal columns with a row of totals; in every fourth the second total is wrong."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table"), F.col("o_orderkey").alias("row"), F.round(F.col("o_totalprice") / 1000, 1).alias("value"))
    both = orders.withColumn("column", F.explode(F.array(F.lit(0), F.lit(1))))
    totals = both.groupBy("table", "column").agg(F.sum("value").alias("v")).select("table", F.lit(-1).cast("long").alias("row"), F.round(F.col("v") + F.when((F.col("table") % 4 == 0) & (F.col("column") == 1), 10).otherwise(0), 1).alias("value"), "column")
    cells = both.withColumn("is_total", F.lit(False)).unionByName(totals.withColumn("is_total", F.lit(True))).withColumn("decimals", F.lit(1))
    return trace.total_mismatches(cells).select("table", "column", "stated", F.round("expected", 1).alias("expected"))


# Evaluation: the toxic flag, turned round, as a guess at quality.

GUESS = "g AS (SELECT quality AS gold, 1 - toxic AS predicted FROM labels)"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("predicted"))


SCORES = f"""{GUESS}, e AS (SELECT gold AS class, 1 AS g, 0 AS p, 0 AS h FROM g UNION ALL SELECT predicted, 0, 1, CAST(gold = predicted AS INTEGER) FROM g),
s AS (SELECT class, sum(g)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM e GROUP BY 1)"""


@query(f"WITH {SCORES} SELECT class, support, predicted, hits, round(hits / nullif(predicted, 0), 6) AS precision, round(hits / nullif(support, 0), 6) AS recall FROM s")
def agg_classscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_scores(_guesses(spark, sf_dir))


@query(f"WITH {SCORES} SELECT round(avg(2 * hits / (support + predicted)), 6) AS macro_f1, count(*) AS classes FROM s WHERE support + predicted > 0")
def agg_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(evaluate.class_scores(_guesses(spark, sf_dir)))


@query(f"""WITH {GUESS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE gold = predicted) AS hits, max(c) AS m FROM g, (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM g GROUP BY gold)))
SELECT n, hits, round(hits / n, 6) AS accuracy, round(greatest(0, (hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4.0 * n * n))), 6) AS low,
round(least(1, (hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4.0 * n * n))), 6) AS high, round(m / n, 6) AS majority FROM t""")
def agg_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(_guesses(spark, sf_dir))


@query(f"WITH {GUESS} SELECT gold, predicted, count(*) AS n FROM g GROUP BY 1, 2")
def agg_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusions(_guesses(spark, sf_dir))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) <= 25")
def win_topk_strat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", 25).select("doc_id", "lang")


@query("""WITH r AS (SELECT DISTINCT d.doc_id AS id, quality AS gold, regexp_extract_all(lower(text), '[a-z]{3,}') AS ts FROM documents d JOIN labels l USING (doc_id)),
d AS (SELECT id, gold, list_filter(list_distinct(ts), lambda w: NOT list_contains(""" + _STOP + """, w)) AS tokens FROM r),
t AS (SELECT id, gold, unnest(tokens) AS token FROM d), bc AS (SELECT gold AS class, token, count(*) AS total FROM t GROUP BY 1, 2),
cl AS (SELECT gold AS class, count(*) AS docs, sum(len(tokens)) AS words FROM d GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM t), n AS (SELECT count(*) AS d FROM d),
e AS (SELECT t.id, t.gold, cl.class, ln((coalesce(total, 0) - CAST(cl.class = t.gold AS INTEGER) + 1) / (words - CASE WHEN cl.class = t.gold THEN len(d.tokens) ELSE 0 END + v)) AS part,
ln((docs - CAST(cl.class = t.gold AS INTEGER) + 1) / (n.d - 1 + 2)) AS prior FROM t JOIN d ON d.id = t.id CROSS JOIN cl CROSS JOIN v CROSS JOIN n LEFT JOIN bc ON bc.class = cl.class AND bc.token = t.token),
s AS (SELECT id, gold, class, round(sum(part) + max(prior), 6) AS score FROM e GROUP BY 1, 2, 3)
SELECT id, gold, class AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1""")
def agg_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("gold"), text.terms(F.col("text")).alias("tokens"), F.xxhash64(words).alias("said"))
    return evaluate.naive_bayes_held_out(rows.dropDuplicates(["id", "gold", "said"]).drop("said"))


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> role")
def win_lag_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("b", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("b IS NULL OR b <> role").select("conv_id", "turn", "role")


# Streams, run over what is there, and held against the batch SQL.


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.read_events(spark, f"{sf_dir}/events.parque[t]", None)  # a pattern, as a stream takes no path of a single file


@query(ORACLE["agg_daily"])
def st_tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.run_available(stream.daily(_event_stream(spark, sf_dir)), "complete", "daily")


@query()
def st_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.run_available(stream.daily_uniques(_event_stream(spark, sf_dir)), "complete", "uniques")


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
s AS (SELECT *, count(*) FILTER (WHERE b IS NULL OR ts >= b + INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS steps FROM s GROUP BY user_id, n""")
def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.run_available(stream.sessions(_event_stream(spark, sf_dir)), "complete", "sessions")


@query(f"""WITH {STEPS},
a AS (SELECT session, min((t, seq)) AS p FROM steps WHERE name = 'view' GROUP BY 1),
b AS (SELECT s.session, min((t, seq)) AS p FROM steps s JOIN a ON a.session = s.session AND (s.t, s.seq) > a.p WHERE name = 'click' GROUP BY 1),
c AS (SELECT s.session, min((t, seq)) AS p FROM steps s JOIN b ON b.session = s.session AND (s.t, s.seq) > b.p WHERE name = 'purchase' GROUP BY 1)
SELECT session, 1 + CAST(b.p IS NOT NULL AS INTEGER) + CAST(c.p IS NOT NULL AS INTEGER) AS reached FROM a LEFT JOIN b USING (session) LEFT JOIN c USING (session)""")
def st_funnel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stream.run_available(stream.funnel(_event_stream(spark, sf_dir), STAGES), "update", "funnel")
    return changes.groupBy("session").agg(F.max("reached").alias("reached"))


# Papers written from the tables and read back: an order is a paper, its lines cite suppliers, its sentences take a stance by line number.

SAID = ("Unlike prior work on this ", "In this paper we extend ", "Throughout we adopt the protocol of ", "We compare our system with ", "Many systems were described in ")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers; the few lines of an order meet as numbers, and its texts are written from them."""
    fields = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount")
    papers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))
    text = lambda x, of: x[of].cast("string")

    def sentence(x: Column) -> Column:
        number = x["l_linenumber"] % 5
        lead = F.element_at(F.array(*map(F.lit, SAID)), 1 + number)
        tail = F.when(number == 0, F.lit(", our results hold. % \\cite{never}\n")).otherwise(F.lit(" for its main results.\n"))
        return F.concat(lead, F.lit("\\cite{s"), text(x, "l_suppkey"), F.lit(",p"), text(x, "l_partkey"), F.lit("}"), tail)

    def entry(x: Column) -> Column:
        return F.concat(F.lit("\\bibitem{s"), text(x, "l_suppkey"), F.lit("} A. Author "), text(x, "l_linenumber"), F.lit(". \\newblock Title of \\emph{work} "), text(x, "l_suppkey"), F.lit(". \\newblock Venue, 1999; "), (F.lit(2000) + x["l_linenumber"]).cast("string"), F.lit(". arXiv:"), F.lpad((x["l_partkey"] % 10000).cast("string"), 4, "0"), F.lit(".12345\n"))

    def row(x: Column) -> Column:
        return F.concat(F.lit("Line "), text(x, "l_linenumber"), F.lit(" & "), F.format_string("%.1f", x["l_quantity"]), F.lit(" & \\textbf{"), F.format_string("%.2f", x["l_discount"]), F.lit("} \\\\\n"))

    written = lambda part: F.array_join(F.transform("lines", part), "")
    papers = papers.select("paper", written(sentence).alias("s"), written(entry).alias("e"), written(row).alias("r"))
    source = F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\begin{abstract}A short abstract.\\end{abstract}\n\\section{Introduction}\nNothing is cited here.\n\\section{Our Method}\n\\subsection{Parts}\n"), F.col("s"), F.lit("\\begin{tabular}{lrr}\\toprule\nName & Quantity & Discount \\\\ \\midrule\n"), F.col("r"), F.lit("\\bottomrule\\end{tabular}\n\\begin{thebibliography}{9}\n"), F.col("e"), F.lit("\\end{thebibliography}\n\\end{document}"))
    return papers.select("paper", source.alias("source"))


@query("""SELECT o AS paper, section, title, level, kind FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem), (VALUES (0, 'Abstract', 0, 'abstract'), (1, 'Introduction', 1, 'introduction'), (2, 'Our Method', 1, 'method'), (3, 'Parts', 2, 'method')) v(section, title, level, kind)""")
def fn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.sections(_papers(spark, sf_dir)).drop("text")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount) AS n FROM lineitem)
SELECT l_orderkey AS paper, n AS ordinal, unnest(['s' || l_suppkey, 'p' || l_partkey]) AS key, 'method' AS kind, ['contests', 'extends', 'inherits', 'compares', 'background'][1 + l_linenumber % 5] AS stance FROM n""")
def cl_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = markup.citation_commands(_papers(spark, sf_dir))
    stance = cues.read_stance(F.col("before"), F.col("after"), F.col("sentence"))
    return markup.each_key(commands.select("paper", "ordinal", "keys", "kind", stance["stance"].alias("stance"))).select("paper", "ordinal", "key", "kind", "stance")


@query("""SELECT l_orderkey AS paper, 's' || l_suppkey AS key, 'A. Author ' || l_linenumber AS authors, 'Title of work ' || l_suppkey AS title, 2000 + l_linenumber AS year, lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') || '.12345' AS own_id FROM lineitem""")
def fn_bibparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.references(_papers(spark, sf_dir)).drop("venue")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount) AS n FROM lineitem)
SELECT l_orderkey AS paper, n AS "row", 'Line ' || l_linenumber AS row_header, unnest(['Quantity', 'Discount']) AS column_header, unnest([round(l_quantity, 1), round(l_discount, 2)]) AS value, unnest([1, 2]) AS decimals FROM n""")
def fn_buildtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = findings.table_cells(_papers(spark, sf_dir)).where("value IS NOT NULL AND NOT in_header")
    return cells.select("paper", "row", "row_header", "column_header", F.round(F.col("value").cast("double"), 2).alias("value"), "decimals")


ASSUMED = ("We assume that the part arrives on time in all of the cases.", "For simplicity the cost of the part is left out of all the sums.", "We do not assume that parts arrive on time in any of the cases.", "The part arrives on time in all of the cases that we have seen.", "This holds provided that the part arrives on time in all cases.")


@query("SELECT p_partkey, ['stated', 'simplifying', NULL, NULL, 'conditional'][1 + p_size % 5] AS kind FROM part")
def cl_assume(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = F.element_at(F.array(*map(F.lit, ASSUMED)), 1 + F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", cues.read_assumption(sentence)["kind"].alias("kind"))


@query("SELECT page_id, 'Page ' || page_id || ' & more' AS title, url AS link, DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS day FROM pages WHERE page_id % 7 <> 0")
def src_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Page "), number, F.lit(" &amp; more")))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    xml = F.concat(F.lit("<feed><entry><title>"), name, F.lit('</title><link rel="alternate" href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"/><summary>s</summary><published>'), day, F.lit("T00:00:00Z</published></entry></feed>"))
    items = records.feed_items(table(spark, sf_dir, "pages").select(number.alias("source"), xml.alias("xml")))
    return items.select(F.col("source").cast("long").alias("page_id"), "title", "link", F.to_date("published").alias("day"))


# Library views: turns of conversations stand for readings.

READINGS = "r AS (SELECT conv_id AS paper, turn, text, role AS cue, 'turn ' || turn AS about FROM conversations)"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper"), "turn", "text", F.col("role").alias("cue"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("about"))


@query(f"""WITH {READINGS}, h AS (SELECT paper, text, min(CASE WHEN contains(lower(text), 'the of') THEN 0 WHEN contains(lower(cue || ' ' || about), 'the of') THEN 1 WHEN contains(lower(text), 'the') AND contains(lower(text), 'of') THEN 2 ELSE 3 END) AS tier
FROM r WHERE contains(lower(text || ' ' || cue || ' ' || about), 'the') AND contains(lower(text || ' ' || cue || ' ' || about), 'of') GROUP BY 1, 2) SELECT tier, paper, text FROM h ORDER BY tier, least(length(text), 900), paper, text LIMIT 40""")
def top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(_readings(spark, sf_dir), "the  of")


@query(f"WITH {READINGS} SELECT paper, turn FROM r WHERE contains(lower(text || ' ' || cue || ' ' || about), 'tion') ORDER BY paper * 1000 + turn LIMIT 20")
def top_mcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.first_matches(_readings(spark, sf_dir).withColumn("n", F.col("paper") * 1000 + F.col("turn")), "TION", "n").select("paper", "turn")


@query("SELECT p_brand AS id, p_name AS title, count(*) AS votes FROM part GROUP BY 1, 2")
def agg_attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.attested(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("title")))


CHOSEN = """v AS (SELECT p_brand AS id, CASE WHEN p_size % 3 = 0 THEN upper(p_type) ELSE p_type END AS title FROM part), c AS (SELECT id, title, count(*) AS votes, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS folded FROM v GROUP BY 1, 2),
p AS (SELECT *, sum(votes) OVER (PARTITION BY id, folded) AS pool FROM c),
t AS (SELECT id, title FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY pool DESC, folded, length(regexp_replace(title, '[^A-Z]', '', 'g')) DESC, votes DESC, title) = 1)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_size") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type"))
    return library.chosen_titles(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), title.alias("title")))


@query(f"WITH {CHOSEN} SELECT * FROM t")
def agg_attested_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir)


@query(f"WITH t AS (SELECT DISTINCT p_brand AS id, p_type || ' ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END AS title FROM part), f AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS folded FROM t) SELECT id, title FROM f WHERE folded IN (SELECT folded FROM f GROUP BY 1 HAVING count(DISTINCT id) = 1)")
def agg_resolve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise("")
    titles = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), own).alias("title"))
    return library.unclaimed(titles.distinct())


@query("SELECT CASE WHEN p_size % 9 = 0 THEN 'uncategorised' ELSE p_type END AS label, count(*) AS n FROM part GROUP BY 1")
def agg_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.grouped(table(spark, sf_dir, "part").withColumn("c", F.when(F.col("p_size") % 9 == 0, F.lit("")).otherwise(F.col("p_type"))), "c")


@query("""WITH c AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), s AS (SELECT * FROM c ORDER BY n DESC, label LIMIT 6)
SELECT label, n, (SELECT count(*) FROM c) AS "distinct", (SELECT sum(n)::BIGINT FROM c) AS total, round((SELECT sum(n) FROM s) / (SELECT sum(n) FROM c), 6) AS covered FROM s""")
def agg_sections_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.top_with_totals(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT lang, count(*) AS total, count(*) FILTER (WHERE n_chars >= 1000) AS long FROM documents GROUP BY ROLLUP (lang)")
def agg_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.with_total(table(spark, sf_dir, "documents"), "lang", {"total": F.count(F.lit(1)), "long": F.count_if(F.col("n_chars") >= 1000)})


# Geometry: the lines of an order are boxes on its page.

BOXES = "b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id, l_linenumber AS line, CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 9 AS DOUBLE) AS y0, CAST(l_partkey % 40 + 12 AS DOUBLE) AS x1, CAST(l_suppkey % 9 + 4 AS DOUBLE) AS y1 FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 9).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("id"), F.col("l_linenumber").alias("line"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 4).alias("y1"))


_IN_BOTH = "greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


@query(f"WITH {BOXES} SELECT a.page, a.id AS a, c.id AS b, round({_IN_BOTH.format(a='a', b='c')} / 48.0, 6) AS share FROM b a JOIN b c ON a.page = c.page AND a.id < c.id WHERE {_IN_BOTH.format(a='a', b='c')} / 48.0 > 0.2")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.overlapping(_boxes(spark, sf_dir).drop("line"))


@query(f"WITH {BOXES} SELECT r.page, r.id AS rect, w.id AS word FROM b r JOIN b w ON r.page = w.page WHERE (w.x0 + w.x1) / 2 BETWEEN r.x0 - 0.5 AND r.x1 + 0.5 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 - 0.5 AND r.y1 + 0.5")
def join_pointrect(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return geometry.words_in(boxes.drop("line"), boxes.drop("line"))


@query(f"WITH {BOXES}, s AS (SELECT m.page, m.id AS mark, r.id AS reading, round({_IN_BOTH.format(a='m', b='r')} / 48.0, 6) AS score FROM b m JOIN b r ON m.page = r.page AND m.line <= 2 AND r.line > 2) SELECT * FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY page, mark ORDER BY score DESC, reading) = 1")
def join_markreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return geometry.best_reading(boxes.where("line <= 2").drop("line"), boxes.where("line > 2").drop("line"))


@query(f"WITH {BOXES} SELECT page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS words FROM b GROUP BY 1, 2")
def win_group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.lines(_boxes(spark, sf_dir))


@query("WITH l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT regexp_replace(trim(t), '\\d+', '#', 'g') AS text, count(DISTINCT page) AS pages FROM l GROUP BY 1 HAVING count(DISTINCT page) >= 3")
def loc_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return geometry.running_heads(lines)


# More views of sites and edges


@query(f"WITH {EDGES} SELECT paper, key, stance FROM edges WHERE stance IN ('inherits', 'extends')")
def flt_loadbearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where(F.col("stance").isin(*lineage.LEAN)).select("paper", "key", "stance")


@query(f"""WITH {EDGES} SELECT e.paper, e.key, CASE WHEN e.key % 4 = 0 THEN 'own' || e.key WHEN e.key % 4 = 1 THEN 'title' || e.key END AS work FROM edges e""")
def join_title_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference has its own id in every fourth supplier; in every fourth its title, written otherwise, is known."""
    edges, key = _edges(spark, sf_dir).select("paper", "key"), F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    reference = supplier.select(key.alias("key"), F.when(key % 4 == 0, F.concat(F.lit("own"), key.cast("string"))).alias("own_id"), text.fold(F.concat(F.lit("The: Work-of "), key.cast("string"))).alias("folded"))
    papers = edges.select("paper", "key").distinct().join(reference, "key").select("paper", "key", "own_id", "folded")
    titles = supplier.where(key % 4 <= 1).select(text.fold(F.concat(F.lit("the WORK of, "), key.cast("string"))).alias("folded"), F.concat(F.lit("title"), key.cast("string")).alias("title_id"))
    return lineage.resolve_references(edges, papers, titles).select("paper", "key", "work")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 5 IN (0, 1, 4) AND p_size % 3 = 0) AS cited, count(*) FILTER (WHERE p_size % 5 IN (0, 1, 4) AND p_size % 3 = 1) AS shown, count(*) FILTER (WHERE p_size % 5 IN (0, 1, 4) AND p_size % 3 = 2) AS bare FROM part WHERE p_size % 5 IN (0, 1, 4)")
def agg_assump_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = F.element_at(F.array(*map(F.lit, ASSUMED)), 1 + F.col("p_size") % 5)
    found = table(spark, sf_dir, "part").where(cues.read_assumption(sentence).isNotNull()).select(cues.support(F.col("p_size") % 3 == 0, F.col("p_size") % 3 == 1).alias("s"))
    return found.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("s") == s).alias(s) for s in ("cited", "shown", "bare")])


@query("SELECT o_orderkey, -round(o_totalprice, 2) AS value FROM orders")
def num_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("−"), F.format_number("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.parse_decimal(said).cast("double"), 2).alias("value"))


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '2020work' AS key FROM supplier")
def snk_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("s_name", r"\s", "")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.citation_key(F.concat(F.lit("A. B. "), name), F.lit(2020), F.lit("The Work of many")).alias("key"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def src_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven recorded days."""
    return sessions.daily(table(spark, sf_dir, "events")).groupBy("day").agg(F.sum("events").alias("events")).orderBy(F.desc("day")).limit(7)


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS block FROM lineitem")
def win_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a table: how many boundaries stand at or above each row."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count_if(F.col("l_returnflag") == "R").over(order).alias("block"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda x: NOT list_contains(""" + _STOP + """, x)) AS t FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.t, b.t))::BIGINT AS shared FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def set_intersect_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.terms(F.col("text")).alias("t"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 70 AND 230 AND contains(lower(text), 'the') AND NOT regexp_matches(text, '\\\\[A-Za-z]|https?:')")
def flt_presentable(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.col("text")
    return table(spark, sf_dir, "conversations").where(F.length(said).between(70, 230) & F.lower(said).contains("the") & ~said.rlike(r"\\[A-Za-z]|https?:")).select("conv_id", "turn")


@query("""WITH g AS (SELECT toxic = 1 AS spoken, quality = 0 AS gold FROM labels) SELECT count(*) AS n, count(*) FILTER (WHERE spoken) AS spoken, round(count(*) FILTER (WHERE spoken) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE spoken AND gold) / nullif(count(*) FILTER (WHERE spoken), 0), 6) AS precision FROM g""")
def agg_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, and precision where something was said: the toxic flag as a guess at low quality."""
    said = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("spoken"), (F.col("quality") == 0).alias("gold"))
    n, spoken = F.count(F.lit(1)), F.count_if("spoken")
    return said.agg(n.alias("n"), spoken.alias("spoken"), F.round(spoken / n, 6).alias("coverage"), F.round(F.count_if(F.col("spoken") & F.col("gold")) / F.nullif(spoken, F.lit(0)), 6).alias("precision"))

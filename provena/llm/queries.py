"""The queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, linededup, media, mixing, nbsvm, neardup, pii, repeats, rules, simhash, trie, whitening

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("matches")


@query
def op7_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the payload of one figure; its page names it by digest, and the join by digest resolves it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    html = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    sequences = media.interleave(docs.select("doc_id", html.alias("html")), "doc_id", "html")
    payloads = media.store(docs).drop("doc_id")
    return media.resolve(sequences, payloads, "doc_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


@query
def op8_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir)).drop("lang", "source")


@query
def op2_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = nbsvm.fit(docs, nbsvm.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return nbsvm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@query
def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{pii.BASE[k][0]}") for k in range(4)], F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_lines: all lines of the text; n_dropped: those taken out; kept_sha256: of the text that stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = linededup.without_repeats(docs)
    return out.select("doc_id", "n_lines", F.col("__dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The rebuilt beginnings written out as lists of turns, and every pair of a node and a node below it; a checksum of decimal digits by its polynomial.
ORACLE["op11_prefix_trie"] = r"""WITH RECURSIVE own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 4 AS h FROM own),
turns AS (SELECT i.c, o.r, o.t, o.p FROM ids i JOIN own o ON o.c = i.b AND o.p <= i.h UNION ALL SELECT i.c, o.r, o.t, o.p FROM ids i JOIN own o ON o.c = i.c AND o.p > i.h),
lists AS (SELECT i.c, coalesce(list({'r': t.r, 't': t.t} ORDER BY t.p) FILTER (WHERE t.p IS NOT NULL), []) AS l FROM ids i LEFT JOIN turns t ON t.c = i.c GROUP BY i.c),
rows AS (SELECT c, len(l) AS n, d, l[1:d] AS k FROM lists, unnest(range(len(l) + 1)) AS u(d)),
nodes AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256, count(*) FILTER (WHERE n > d) AS longer FROM rows GROUP BY k),
worth AS (SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(k[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM nodes),
below AS (SELECT DISTINCT a.k AS top, b.k AS k FROM rows a JOIN rows b ON b.c = a.c AND b.d >= a.d),
sums AS (SELECT b.top AS k, count(*) FILTER (WHERE w.longer = 0) AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE len(b.k) = len(b.top) + 1) AS n_children FROM below b JOIN worth w ON w.k = b.k GROUP BY 1)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, s.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256 FROM worth w JOIN sums s ON s.k = w.k LEFT JOIN nodes p ON w.depth > 0 AND p.k = w.k[1:w.depth - 1]"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("preorder", "preorder_end")


@query
def op12_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

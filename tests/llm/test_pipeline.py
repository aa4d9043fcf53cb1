import base64
import collections
import hashlib
import re

import public_tokenizers
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from provena.llm import mixing, nbsvm, repeats
from provena.llm.queries import QUERIES
from provena.llm.staging import staged

from .fixtures import SCHEMA, awkward
from .test_arrow_operators import TEXTS, write
from .test_joins import brute_lines, brute_near, near_copies
from .test_mix_rules_quality import check_mix

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    run = lambda name, df: staged(stage[name](spark, df, SF), "test")

    good = run("quality classifier", docs)
    model = nbsvm.fit(docs, nbsvm.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    want = {r.doc_id for r in nbsvm.score(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    lines = run("line dedup", good)
    expected = {i: t for i, t in brute_lines(good.collect()).items() if t.strip()}
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {i: (t, len(t)) for i, t in expected.items()} and lines.columns == docs.columns

    near = run("MinHash near-dedup", lines)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, _, kept) in brute_near(lines.collect()).items() if kept} and near.columns == docs.columns

    mixed = run("mixing to target weights", near)
    assert mixed.columns == docs.columns
    times = collections.Counter(r.doc_id for r in mixed.collect())
    plan = {r.doc_id: r for r in mixing.mix(near).collect()}
    texts = {r.doc_id: r.text for r in near.collect()}
    check_mix(near.collect(), [Row(doc_id=i, source=r.source, size=r["size"], source_size=r.source_size, target=r.target, taken=r["size"] * times[i], times=times[i], shards=list(range(times[i])), text=texts[i]) for i, r in plan.items()])

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = run("byte-level BPE", mixed).collect()
    assert collections.Counter(r.doc_id for r in coded) == times
    assert all(r.ids == encoding.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in coded)


def test_run_is_the_stages_one_after_another(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    df = awkward(spark, TEXTS)
    folder = write(spark, df, tmp_path)
    spark.createDataFrame([(3, 1, 0), (4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).columns[0] == "doc_id"
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), "test")
        assert docs.columns == df.columns


def brute_repeats(texts):
    count = collections.Counter(t[n : n + 400] for t in texts for n in range(len(t) - 399))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for n in range(len(t) - 399):
            if count[t[n : n + 400]] > 1:
                covered[n : n + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((len(t), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_windows_against_brute_force(spark, tmp_path):
    common = "é".join(near_copies(1, 1, 3))
    long = near_copies(3, 6, 20)
    texts = [t[:1500] for t in long] + ["ab" * 900, "x" * 401, "x" * 400, common[:399], common[50:460], common[60:470] + "tail", "head" + common[100:530] + common[100:530], common[:700] + "z" + common[701:1400]]
    df = awkward(spark, texts)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_radix_repeats"](spark, write(spark, df, tmp_path)).collect())
    rows = df.collect()
    assert got == sorted((r.doc_id, *b) for r, b in zip(rows, brute_repeats([(r.text or "").encode() for r in rows])))


def test_repeats_of_the_tables_with_small_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: b[:3] for r, b in zip(rows, brute_repeats([r.text.encode() for r in rows]))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()} == want
    monkeypatch.setattr(repeats, "PART", 3000)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()} == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_anchors_are_chosen_by_their_windows(monkeypatch):
    import numpy as np

    raw = np.random.default_rng(1).integers(97, 101, 30_000).astype(np.uint8)
    ends = np.array([10_000, 10_100, 30_000])

    def chosen() -> dict:
        return {s: p for p, a, b in zip(*(c.tolist() for c in repeats.anchors(raw, ends))) for s in range(a, b + 1)}

    whole = chosen()
    assert sorted(whole) == [*range(9601), *range(10_100, 29_601)]
    assert all(s <= p <= s + repeats.REACH for s, p in whole.items())
    monkeypatch.setattr(repeats, "PART", 1500)
    assert chosen() == whole
    places = repeats.anchors(raw, ends)[0]
    assert len(places) == len(set(places.tolist()))


def test_rows_of_a_very_common_digit_are_split_over_tasks(spark):
    name = "spark.sql.adaptive."
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", name + "coalescePartitions.enabled": "false", name + "advisoryPartitionSizeInBytes": "16k", name + "skewJoin.skewedPartitionThresholdInBytes": "16k", name + "skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = staged(spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") - F.col("id") % 2).alias("gram"), "id"), "test")
        met = rows.join(repeats._repeated(rows, "gram"), "gram")
        n = collections.Counter(r.gram for r in rows.collect())
        assert len(met.collect()) == sum(x for x in n.values() if x > 1) and max(n.values()) == 40_000
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_schema_of_fixture_matches(spark):
    assert awkward(spark).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert awkward(spark).where(F.col("doc_id") == 3).count() == 2

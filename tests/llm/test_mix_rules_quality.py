import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import mixing, nbsvm, rules
from provena.llm.queries import QUERIES

from .fixtures import SCHEMA, awkward
from .test_arrow_operators import write

SF = "/root/testdata/sf0.01"
TEXTS = ["a b c d e\na b c d e\nx", "one two three four five six one two three four five six", "# $ % & | < > *\n \n\n# $ % & | < > *", "w " * 12, "a a a a a a a"]


def filled(sizes, weights, total):
    """Shares by weight, what is above three times a source's size given to the others again and again."""
    open_, fixed = set(sizes), {}
    while True:
        left, w = total - sum(fixed.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weights[s] / w for s in open_}
        fixed |= {s: 3.0 * sizes[s] for s in over}
        open_ -= set(over)


def check_mix(documents, got):
    sizes = collections.defaultdict(int)
    for r in documents:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: n % 3 + 1 for n, s in enumerate(order)}, sum(sizes.values()))
    taken, largest = collections.defaultdict(int), collections.defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) if hasattr(r, "text") else True
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * r.times == r["size"] * len(r.shards)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], target[s])


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = mixing.mix(docs)
    rows = first.collect()
    assert len(rows) == docs.count()
    check_mix(docs.collect(), rows)
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    shards = collections.Counter(s for r in rows for s in r.shards)
    assert set(shards) <= set(range(2**mixing.LEVELS))


def test_mix_of_skewed_and_awkward_rows(spark):
    random.seed(1)
    rows = [(n, "w " * random.randint(1, 40), "en", "hot" if n % 3 else f"s{n % 7}", 1, n, "x", 1) for n in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_mix(docs.collect(), mixing.mix(docs).collect())
    odd = awkward(spark)
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and {r.source for r in got} == {"a", "b", None}
    assert mixing.mix(odd.limit(0)).count() == 0
    clash = odd.withColumn("target", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("shards", F.lit(3))
    assert mixing.mixed(clash).columns == [*clash.columns, "__shard"]


def test_rows_without_id_and_equal_rows_are_drawn_one_by_one(spark):
    rows = [(None, "w w w w w", "en", "none", 1, 1, "x", 1)] * 1000 + [(5, f"one id {n}", "en", "shared", 1, n, "x", 1) for n in range(500)] + [(n, "a b c", "en", "own", 1, n, "x", 1) for n in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plan = mixing.mix(docs).collect()
    check_mix(docs.collect(), plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    out = collections.Counter(r.source for r in mixing.mixed(docs).collect())
    times = collections.Counter()
    for r in plan:
        times[r.source] += r.times
    assert out == times


def test_mixed_rows_follow_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    out = collections.Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect())
    assert out == {k: v for k, v in plan.items() if v}


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for n in range(len(words) - 4):
        windows[tuple(words[n : n + 5])].append(n)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_rule_statistics_against_brute_force(spark, tmp_path):
    for df in (awkward(spark, TEXTS), spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.statistics(df).withColumnRenamed("__id", "doc_id").collect()), key=str)
        assert got == sorted(((r.doc_id, *brute_rules(r.text)) for r in df.collect()), key=str)


def test_rules_reject_outliers_and_keep_the_rest(spark, tmp_path):
    random.seed(2)
    texts = [" ".join("".join(random.choices("abcdefgh", k=random.randint(2, 9))) for _ in range(random.randint(40, 400))) for _ in range(400)]
    odd = ["| # $ " * 3 + " ".join("q" * random.randint(60, 90) for _ in range(40)) + " # | $" * 40 for _ in range(5)]
    odd = [" ".join(f"{w}{n}" for n, w in enumerate(t.split())) for t in odd]
    rows = [(n, t, "en", "s", 1, n, "x", 1) for n, t in enumerate(texts + odd)]
    got = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[n].kept for n in range(400))
    assert not any(got[n].kept for n in range(400, 405))
    few = rules.apply_rules(awkward(spark)).collect()
    assert len(few) == 7 and all(r.kept == (not r.base_failed) for r in few)
    assert rules.apply_rules(awkward(spark).limit(0)).count() == 0


def test_estimate_is_close_to_a_brute_force_covariance(spark):
    rng = np.random.default_rng(3)
    clean = rng.multivariate_normal(np.arange(5), np.diag([1, 2, 1, 0.5, 0.5]) + 0.2, 4000)
    bad = rng.normal(12, 0.5, (400, 5))
    df = spark.createDataFrame([("g", [float(x) for x in z]) for z in np.vstack([clean, bad])], "__group string, __z array<double>")
    row = rules.estimates(df, 5).collect()[0]
    assert np.abs(np.array(row["__centre"]) - clean.mean(0)).max() < 0.25
    factor = np.array(row["__factor"]).reshape(5, 5)
    distance = np.square((clean - np.array(row["__centre"])) @ factor.T).sum(1)
    assert 3.3 < np.median(distance) < 5.0
    assert (np.square((bad - np.array(row["__centre"])) @ factor.T).sum(1) > rules.REJECT).all()


def brute_least_determinant(z, share, floors, tries=200):
    """Least log determinant of the covariance, with the floors, of a share of the rows: concentration from random starts until nothing changes."""
    rng, take, best = np.random.default_rng(5), int(np.ceil(share * len(z))), np.inf
    for _ in range(tries):
        rows = rng.choice(len(z), 8, replace=False)
        for _ in range(50):
            centre, cov = z[rows].mean(0), np.cov(z[rows].T, bias=True) + np.diag(np.square(floors))
            off = z - centre
            nearest = np.sort(np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:take])
            if len(nearest) == len(rows) and (nearest == rows).all():
                break
            rows = nearest
        best = min(best, np.linalg.slogdet(np.cov(z[rows].T, bias=True) + np.diag(np.square(floors)))[1])
    return best


def test_least_determinant_against_random_starts(spark):
    rng = np.random.default_rng(9)
    turn = rng.normal(size=(5, 5))
    clean = np.round(rng.multivariate_normal(np.zeros(5), turn @ turn.T + 0.5 * np.eye(5), 170) * 1024) / 1024
    far = np.round((rng.normal(0, 0.3, (30, 5)) + 3 * np.array([1, -1, 1, -1, 1])) * 1024) / 1024
    groups = {"mixed": np.vstack([clean, far]), "plain": clean, "constant": np.ones((70, 5))}
    df = spark.createDataFrame([(g, [float(x) for x in row]) for g, z in groups.items() for row in z], "__group string, __z array<double>")
    reached = rules.concentrated(df, 5)
    every = {(r["__group"], r["__start"]): r["__logdet"] for r in reached.collect()}
    chosen = {r["__group"]: r for r in rules.least_of(df, reached, 5).collect()}
    for g, z in groups.items():
        assert len([k for k in every if k[0] == g]) == 3
        assert chosen[g]["__logdet"] == pytest.approx(min(v for k, v in every.items() if k[0] == g), abs=1e-6)
        assert abs(chosen[g]["__logdet"] - brute_least_determinant(z, rules.SHARE, rules.FLOORS)) < 0.3
    factor = np.array(chosen["plain"]["__factor"]).reshape(5, 5)
    inside = np.square((clean - np.array(chosen["plain"]["__centre"])) @ factor.T).sum(1)
    assert abs(np.quantile(inside, rules.SHARE) - rules.CHI2_SHARE) < 1.0  # consistent, neither too near nor too far


def test_classifier_on_held_out_labels(spark):
    rows = QUERIES["op2_nbsvm_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = np.mean([r.predicted == r.quality for r in held])
    good = np.mean([r.predicted for r in held if r.quality == 1])
    assert right > 0.93 and good > 0.97, (right, good)


def test_classifier_edges(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = nbsvm.fit(docs, none)
    assert {r.score for r in nbsvm.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (None, 0), (4, None)], "doc_id long, quality int")
    scores = nbsvm.score(docs, nbsvm.fit(docs, one)).collect()
    assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)
    assert nbsvm.keep(docs, model).columns == docs.columns
    kept = nbsvm.learnable(spark.range(0, 300).withColumnRenamed("id", "doc_id"))
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in kept.collect())


def test_descent_separates():
    rows, labels = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5, np.array([1, 1, 0, 0] * 5)
    w = nbsvm.descend(rows, labels, np.ones(4), 1)
    margin = [w[r].sum() / np.sqrt(2) + w[-1] for r in rows]
    assert all((m > 0) == (y == 1) for m, y in zip(margin, labels))


def test_shards_hold_what_the_tree_dealt_them(spark, tmp_path):
    random.seed(2)
    rows = [(n, "w " * random.randint(1, 40), "en", f"s{n // 500}", 1, n, "x", 1) for n in range(3000)]
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(6, "source").write.parquet(f"{tmp_path}/docs")  # a file for each source
    docs = spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixing.mixed(docs).withColumn("part", F.spark_partition_id()).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = spark.read.parquet(f"{tmp_path}/out").select("part", "__shard", "source", "doc_id").collect()
    assert collections.Counter((r["__shard"], r.doc_id) for r in out) == collections.Counter((s, r.doc_id) for r in mixing.mix(docs).collect() for s in r.shards)
    spans = collections.defaultdict(set)
    for r in out:
        spans[r.part].add(r["__shard"])
    ordered = [spans[p] for p in sorted(spans)]
    assert len(ordered) > 2 and all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:]))  # shards follow one another over the files
    sources = collections.defaultdict(set)
    for r in out:
        sources[r.part].add(r.source)
    assert all(len(s) == 6 for s in sources.values())

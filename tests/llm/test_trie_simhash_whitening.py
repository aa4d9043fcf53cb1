import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provena.llm import order, simhash, trie, whitening
from provena.llm.queries import ORACLE, QUERIES

from ..parity import differences, oracle
from .fixtures import awkward
from .test_joins import union_find

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, node string, depth int, place long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TALK)


def brute_trie(rows):
    own = collections.defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            own[r.conv_id].append(((r.turn is not None, r.turn or 0), hashlib.sha256(f"{len(r.role or '')}:{r.role or ''}{r.text or ''}".encode()).digest()[:16], (r.role or "", r.text or "")))
    own = {c: [t for _, _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    below = collections.defaultdict(list)
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    worth = lambda k: (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(k))))
        leaves = sum(len(below[x]) == 1 for x in below[k])
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), sum(len(x) == len(k) + 1 for x in below[k]), leaves, sum(map(worth, below[k])), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(df):
    return sorted((tuple(r) for r in df.drop("preorder", "preorder_end").collect()), key=str)


def test_trie_gives_what_its_sql_gives(spark):
    assert differences(spark, oracle(SF), QUERIES["op11_prefix_trie"], ORACLE["op11_prefix_trie"], SF) == []


def test_trie_of_copies_forks_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)  # so that the ids of the copies come in several lists
    random.seed(3)
    rows = [(c, t, "user", f"same words {t}") for c in range(1000, 1060) for t in range(4)]
    rows += [(c, t, random.choice("ab"), random.choice(["x", "y z"])) for c in range(0, 150) for t in range(random.randint(1, 6))]
    rows += [(2000, t, "user", f"turn {t}") for t in range(300)] + [(2020, t, "user", f"turn {t}") for t in range(250)] + [(2040 + n, t, "user", f"turn {t}") for n in range(3) for t in range(100 + n)]
    df = talk(spark, rows).repartition(5)
    assert nodes_of(trie.prefix_trie(df)) == brute_trie(df.collect())


def test_trie_of_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, "user", "b"), (1, 1, None, None), (1, 1, "", ""), (1, 2, "user", "b"), (1, 2, "user", "b"), (21, None, "user", "b"), (-5, 3, "a:", "b"), (-5, 4, "a", ":b"), (-3, 3, "a", "1:ab"), (7, 1, "r", "only"), (8, 1, "r", "word " * 20_000), (8, 1, "q", "tie"), (9, 0, "r", "gone"), (29, 0, "r", "gone")]
    rows += [(40 + n, 0, "r", "t") for n in range(12)]
    df = talk(spark, rows)
    assert nodes_of(trie.prefix_trie(df)) == brute_trie(df.collect())
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_intervals_nest(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    spans = sorted((r.preorder, r.preorder_end, r.depth) for r in trie.prefix_trie(df).collect())
    open_ = []
    for at, end, depth in spans:
        while open_ and open_[-1][1] < at:
            open_.pop()
        assert len(open_) == depth and all(end <= e for _, e in open_)
        open_.append((at, end))


def test_running_sums_over_parts_and_ties(spark):
    df = spark.createDataFrame([(n % 3 if n % 2 else 0, 7, n) for n in range(500)], "g int, k int, v int").repartition(6)
    placed = order.in_order(df, F.col("g"), F.col("k"))
    got = [(r.g, r.n, r.s) for r in order.running(placed, ["g"], n=F.lit(1), s=F.col("v")).collect()]
    for g in range(3):
        own = sorted((n, s) for h, n, s in got if h == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        assert own[-1][1] == sum(n for n in range(500) if (n % 3 if n % 2 else 0) == g)
    assert sorted(r.n for r in order.running(placed, [], n=F.lit(1)).collect()) == list(range(1, 501))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[n : n + 3]) for n in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows):
    prints = [brute_fingerprint(r.text) for r in rows]
    distinct = sorted(set(prints))
    of = union_find(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[of[p]] = min(least.get(of[p], r.doc_id), r.doc_id)
    return sorted(((r.doc_id, f"{p:016x}", least.get(of[p])) for r, p in zip(rows, prints)), key=str)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("z").alias("fp"), F.lit(1).alias("component"))
    random.seed(8)
    base = [" ".join(random.choices("abcdefgh", k=400)) for _ in range(6)]
    near = [(1000 + n, base[n % 6][: 790 - n % 13] + f" {n % 7}", "z", 1) for n in range(120)]
    df = docs.union(spark.createDataFrame(near, "doc_id long, text string, fp string, component int"))
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_simhash(df.collect())
    assert len({g[2] for g in got}) < len({g[1] for g in got}) < len(got)


def test_simhash_of_awkward_rows(spark):
    odd = awkward(spark, ["One Two", "one two", "\x1c a\x0bb"]).unionByName(awkward(spark).where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    assert got == brute_simhash(odd.collect())
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_links_of_crowded_keys_are_those_of_all_pairs(spark, monkeypatch):
    random.seed(9)
    prints = {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(40):
        p = random.getrandbits(32) << 32 | 5
        for _ in range(20):
            prints.add(simhash._signed(p ^ 1 << random.randrange(64) ^ 1 << random.randrange(64) ^ 1 << random.randrange(64)))
    prints = sorted(simhash._signed(p % (1 << 64)) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = union_find(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2])
    for crowd in (1000, 3, 1):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = [(r.a, r.b) for r in simhash.links(df).collect()]
        assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in found)
        assert union_find(prints, found) == want


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, x string")


def brute_whitening(rows):
    x = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows]
    m = np.array([v for _, v in x], dtype=object)
    n, sums = len(m), m.sum(axis=0)
    off = m * n - sums
    centred = off.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [(i, int((o * o).sum())) for (i, _), o in zip(x, off)], centred @ axes[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    n, deviations, projected, explained = brute_whitening(rows)
    got = collections.defaultdict(dict)
    for r in QUERIES["op13_jacobi_whitening"](spark, SF).collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-9
    signs = {}
    for (i, d), w in zip(deviations, projected):
        assert sorted(got[i]) == list(range(1, 9))
        for k in range(8):
            r = got[i][k + 1]
            sign = signs.setdefault(k, np.sign(r.whitened * w[k]))
            assert r.deviation == d and abs(r.whitened * sign - w[k]) < 1e-6 and abs(r.explained - explained[k]) < 1e-9


def test_whitening_of_awkward_rows(spark):
    random.seed(2)
    good = [(n, [random.gauss(0, s) for s in (1.0, 0.5, 0.25)]) for n in range(40)] + [(None, [1.0, 0.5, 0.0]), (3, [0.1, 0.2, 0.3]), (3, [0.1, 0.2, 0.3])]
    bad = [(50, None), (51, [1.0, None, 0.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, [1e30, 0.0, 0.0]), (55, []), (56, [1.0, 2.0])]
    df = vectors(spark, good + bad).repartition(3)
    out = whitening.whiten(df).collect()
    assert len(out) == 3 * len(good) and {r.n for r in out} == {len(good)} and {r.component for r in out} == {1, 2, 3}
    _, deviations, _, explained = brute_whitening([(i, [float(np.float32(c)) for c in v]) for i, v in good])
    assert sorted(((r.vec_id, r.deviation) for r in out if r.component == 1), key=str) == sorted(deviations, key=str)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(vectors(spark, bad[:5])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.5])] * 3)).count() == 0  # nothing varies
    flat = whitening.whiten(vectors(spark, [(n, [float(n), 2.0 * n, 1.0]) for n in range(9)])).collect()
    assert {r.component for r in flat} == {1} and all(r.identity_error < 1e-9 for r in flat)


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    values = 10.0 ** -np.arange(20)
    scaled = (q * values) @ q.T
    got, axes = whitening.jacobi((scaled + scaled.T) / 2)
    assert np.allclose(got[:10], values[:10], rtol=1e-5) and np.allclose(axes.T @ axes, np.eye(20), atol=1e-12)
    assert np.allclose(axes @ np.diag(got) @ axes.T, scaled, atol=1e-14)


def test_exact_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 1]])
    sums = x.sum(axis=0)
    assert whitening._deviation(x, 2, sums).to_pylist() == [None, None]
    big = np.array([[3_000_000_000, 1], [1, 0]])
    assert whitening._deviation(big, 1, np.zeros(2, np.int64)).to_pylist() == [9_000_000_000_000_000_001, 1]

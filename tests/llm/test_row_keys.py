"""Rows without an id, and one id with different texts."""

import collections

from provena.llm import linededup, neardup, repeats

from .fixtures import SCHEMA, unnamed
from .test_pipeline import brute_repeats


def test_line_dedup_keeps_one_of_every_line_whatever_the_ids(spark):
    docs = unnamed(spark)
    before = collections.Counter(x for r in docs.collect() for x in (r.text or "").split("\n") if x.strip())
    out = linededup.without_repeats(docs).collect()
    after = collections.Counter(x for r in out for x in (r.text or "").split("\n") if x.strip())
    assert len(out) == docs.count() and max(before.values()) == 3
    assert after == {x: 1 for x in before}


def test_repeats_are_cut_from_the_text_they_stand_in(spark):
    docs = unnamed(spark)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect())
    rows = docs.collect()
    want = sorted((str(r.doc_id), *b[:3]) for r, b in zip(rows, brute_repeats([(r.text or "").encode() for r in rows])))
    assert got == want and sum(n > 0 for _, _, n, _ in got) == 3


def test_near_copies_without_id_or_under_one_id(spark):
    base = [f"word{n * 37 % 101}" for n in range(100)]
    copy, other, third = " ".join(base), " ".join(f"else{n}" for n in range(60)), " ".join(f"third{n}" for n in range(60))
    near = copy + " and more"
    texts = [(2, copy), (3, near), (3, other), (None, other + " end"), (None, third), (None, third + " end"), (9, "one of a kind")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 1, "x", 1) for i, t in texts], SCHEMA)
    kept = {r.text for r in neardup.without_copies(docs).collect()}
    assert kept - {third, third + " end"} == {copy, other, "one of a kind"} and len(kept) == 4
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(2, 2), (3, 2), (3, 3), (None, 3), (None, None), (9, 9)}

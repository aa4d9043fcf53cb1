import random

import duckdb

from provena.operators import anchors, locate
from provena.plans import places
from provena.plans.queries import ORACLE

from .parity import differences


def brute(docs, quotes):
    bare = lambda t: "".join((t or "").lower().split())
    out = set()
    for d, text in set(docs):
        for q, quote in quotes:
            hay, needle = bare(text), bare(quote)
            at = [n for n in range(len(hay) - len(needle) + 1) if hay[n : n + len(needle)] == needle] if len(needle) >= locate.LEAST else []
            if at:
                out.add((q, d, min(len(at), locate.MOST), at[0]))
    return out


def test_quotes_are_found_wherever_they_stand(spark):
    random.seed(6)
    docs = [(n, "".join(random.choices("ab ", k=random.randint(0, 400)))) for n in range(30)] + [(30, None), (31, ""), (32, "ab" * 200), (None, "é word 🙂 of the text and more"), (33, "x" * 5000), (33, "other text under one id: word of the text")]
    docs += [docs[0]]
    quotes = [(1000 * n + k, docs[n][1][k : k + 40]) for n in range(30) for k in (0, 7, 100) if len(docs[n][1]) > k + 40] + [(-1, "ab" * 8), (-2, "short"), (-3, "É WORD 🙂 of the text"), (-4, "x" * 16), (-5, "nowhere to be found at all"), (-6, None)]
    got = locate.locate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(docs, quotes)


def test_no_part_of_a_fabricated_quote_is_anchored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    made = spark.createDataFrame([(r.item_id, " ".join(w[::-1] for w in reversed(r.text.split()))) for r in rows], "item_id long, text string")
    assert locate.locate(docs, made).count() == 0 and locate.locate_longest(docs, made).count() == 0


def test_longest_part_of_a_quote(spark):
    docs = spark.createDataFrame([(1, "We find that the well-known method works on all of the data that we have."), (2, "works on all of the data that we have"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "We find that the well known method works on some of the data"), (2, "never works on all of the data that we have"), (3, "We find that it does not hold for anything else")], "item_id long, text string")
    got = {(r.item_id, r.doc_id): (r.part, r.side, r.start) for r in locate.locate_longest(docs, quotes).collect()}
    assert got == {(1, 1): ("We find that the well known method works on", "beginning", 0), (2, 1): ("works on all of the data that we have", "end", 28), (2, 2): ("works on all of the data that we have", "end", 0)}


def test_short_texts_on_a_page_only_if_there_is_no_doubt(spark):
    pages = spark.createDataFrame([(1, "28.4 and 28.4 and 31-7"), (2, None)], "page long, text string")
    wanted = spark.createDataFrame([(1, 1, "28.4"), (2, 1, "317"), (3, 1, "x"), (4, 2, "317"), (5, 1, "aaa")], "item_id long, page long, text string")
    assert [tuple(r) for r in locate.on_page(pages, wanted).collect()] == [(2, 1, 14)]
    twice = spark.createDataFrame([(1, "aaaa")], "page long, text string")
    assert locate.on_page(twice, wanted).count() == 0  # overlapping places are two


def test_anchors_and_what_they_promise(spark):
    rows = [(1, n, w, 0, n // 4, n % 4 * 10.0, n // 4 * 12.0, n % 4 * 10.0 + 9, n // 4 * 12.0 + 10) for n, w in enumerate("a bb - cc dd ee ff gg".split())]
    words = spark.createDataFrame(rows, "doc_id long, n long, word string, page int, line int, x0 double, y0 double, x1 double, y1 double")
    placed = anchors.spans(spark.createDataFrame([(7, 1, 1, 6)], "item_id long, doc_id long, start long, end long"), words)
    assert [tuple(r) for r in placed.collect()] == [(7, 1, 1, 4)]
    found = anchors.anchor(placed, words)
    assert {(r.line, r.x0, r.x1, r.precision) for r in found.collect()} == {(0, 10.0, 39.0, "tight"), (1, 0.0, 9.0, "tight")}
    assert [(r.ok, r.why) for r in anchors.roundtrip(found, words).collect()] == [(True, "ok")]
    raised = words.withColumn("y0", words.y0 - (words.n == 2).cast("int") * 30).withColumn("y1", words.y1 - (words.n == 2).cast("int") * 30)
    assert [r.why for r in anchors.roundtrip(anchors.anchor(placed, raised), raised).collect()] == ["a word lies outside"]
    wide = found.withColumn("x1", found.x1 + 10)
    assert [r.why for r in anchors.roundtrip(wide, words).collect()] == ["a foreign word lies inside"]


def test_every_place_of_a_quote_is_anchored(spark, tmp_path):
    said, gap = "the quoted words that stand here more than once", " ".join(f"w{n}" for n in range(385))
    documents = [(1, f"{said} {gap} {said} and {said}"), (2, f"x {said[:20]}-{said[20:]} y {said.upper()}."), (3, "ab" * 30 + " " + "ab" * 30), (4, "é 🙂 short, é 🙂 short"), (5, None), (6, "nothing"), (None, said), (7, " - ".join([said] * 70))]
    quotes = [(1, said), (2, "ab" * 10), (3, "🙂 Short"), (4, "x"), (5, ""), (6, None), (7, "nowhere to be found at all")]
    spark.createDataFrame(documents, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert differences(spark, db, places.loc_anchor, ORACLE["loc_anchor"], str(tmp_path)) == []
    found = {(r.item_id, r.doc_id, r.first) for r in places.loc_anchor(spark, str(tmp_path)).collect()}
    assert {(1, 1, 0), (1, 1, 394), (1, 1, 404), (1, 2, 1), (3, 4, 1), (3, 4, 4), (4, 2, 0)} <= found and len({f for q, d, f in found if (q, d) == (1, 7)}) == 70
    # The check of the anchors still reads the first place of each pair.
    first = [q for q in quotes if len(q[1] or "") >= locate.LEAST]
    spark.createDataFrame(first, "item_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert differences(spark, db, places.loc_roundtrip, ORACLE["loc_roundtrip"], str(tmp_path)) == []

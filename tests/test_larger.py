"""Faults that only larger tables show: plans that send rows through the driver, and numbers that lie on a border of rounding."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from provena.functions.numbers import rounded
from provena.operators import evaluate, findings, locate
from provena.plans import checks, claims, places, sources
from provena.plans.queries import ORACLE, agg_nb
from tests.parity import differences, oracle

SMALL = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_as_sql_does(spark):
    values = [67.085, 73.225, 0.05, 2.5, -2.5, -67.085, 0.0, None]
    want = [r[0] for r in duckdb.sql("SELECT round(x::DOUBLE, 2) FROM (SELECT unnest(?) AS x)", params=[values]).fetchall()]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 2)).collect()] == want


def test_same_measure_where_printed_digits_round_otherwise(spark, tmp_path):
    rows = "SELECT 1::BIGINT AS l_orderkey, 1 AS l_linenumber, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 72497.29::DOUBLE AS l_extendedprice UNION ALL SELECT 1, 2, 1, 1, 73220.0"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert db.execute(ORACLE["join_samemeasure"]).fetchall() == [(1, 1, 0, 2)]
    assert differences(spark, db, claims.join_samemeasure, ORACLE["join_samemeasure"], str(tmp_path)) == []


@pytest.mark.parametrize("name", ["join_restated", "join_accounted", "join_samemeasure"])
def test_numbers_are_traced_without_broadcasts(spark, name):
    assert "Broadcast" not in plan(getattr(claims, name)(spark, SMALL))


def test_contradictions_are_found_without_broadcasts(spark):
    assert "Broadcast" not in plan(checks.chk_mismatch(spark, SMALL))


@pytest.mark.parametrize("name", ["fn_allmacros", "fn_usermacros", "fn_nummacros", "fn_stripdefs", "fn_expandmacros", "fn_equations", "fn_envspans", "fn_blankenv"])
def test_sources_are_shuffled_never_and_lines_once(spark, name):
    found = plan(getattr(sources, name)(spark, SMALL))
    assert found.count("Exchange hash") == 1 and "Join" not in found and "latex-tokens" not in found


def test_equations_are_read_in_one_pass_of_the_helper(spark):
    found = plan(sources.fn_equations(spark, SMALL))
    assert found.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in found


@pytest.mark.parametrize(("name", "exchanges"), [("src_findmain", 1), ("src_inputs", 2), ("src_load", 2)])
def test_files_of_archives_meet_once(spark, name, exchanges):
    found = plan(getattr(sources, name)(spark, SMALL))
    assert found.count("Exchange hash") == exchanges and "Join" not in found and "archive-" not in found


@pytest.mark.parametrize(("name", "exchanges"), [("flt_folded", 1), ("flt_leftlabel", 1), ("agg_compgroup", 1), ("win_headerrows", 1), ("chk_aggregate", 2)])
def test_cells_of_tables_stay_with_their_paper(spark, name, exchanges):
    found = plan(getattr(checks, name)(spark, SMALL))
    assert found.count("Exchange hash") == exchanges and "/cells-" not in found and "Broadcast" not in found


def test_plants_are_listed_and_checked_without_further_passes_over_all_cells(spark):
    cells = checks._cells(spark, SMALL, wrong=False)
    halves = findings.folded(cells).localCheckpoint()
    spoilt, ledger = findings.plant_totals(cells, halves=halves)
    assert "Join" not in plan(ledger) and "lineitem" not in plan(ledger) and "SortMergeJoin" not in plan(spoilt)
    checked = findings.aggregate_mismatch({"cells": spoilt, "halves": halves})
    assert plan(checked).count("FileScan parquet [l_orderkey") == 1
    alone = findings.aggregate_mismatch({"cells": spoilt})
    assert sorted(map(str, checked.collect())) == sorted(map(str, alone.collect())) and checked.count() == ledger.count()


@pytest.mark.parametrize("name", ["loc_anchor", "loc_roundtrip"])
def test_only_documents_that_hold_a_quote_are_set_in_words_and_once(spark, name):
    found = getattr(places, name)(spark, SMALL)
    words = spark.read.parquet(*[f for f in found.inputFiles() if "/anchors-words-" in f])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert "Generate" not in plan(found) and ids(words) == ids(found) and len(ids(words)) < spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_only_texts_that_meet_a_quote_are_folded_again(spark):
    documents, quotes = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert "LeftSemi" in plan(locate.locate(documents, quotes))


def test_naive_bayes_reads_texts_once_and_sums_up_before_it_joins(spark):
    found = plan(agg_nb(spark, SMALL))
    assert "regexp_extract_all" not in found and "/bayes-rows-" in found and "/bayes-tokens-" in found


def test_naive_bayes_where_rows_and_ids_repeat(spark, tmp_path):
    documents = [(1, "red red apple pie"), (1, "red red apple pie"), (2, "green apple"), (3, "green stone wall"), (3, "red wall"), (4, ""), (5, None), (6, "stone stone wall built"), (7, "the of 12 ab"), (None, "red apple"), (8, "nothing alike"), (9, "unlabelled apple")]
    labels = [(1, 1), (1, 1), (2, 1), (3, 0), (3, 1), (4, 0), (5, 1), (6, 0), (7, 0), (None, 1), (8, 0)]
    spark.createDataFrame(documents, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert differences(spark, db, agg_nb, ORACLE["agg_nb"], str(tmp_path)) == []


def test_naive_bayes_counts_tokens_that_repeat_in_a_document(spark):
    rows = [(1, 0, ["a", "b", "a", "a"]), (2, 0, ["a", "c"]), (3, 1, ["b", "b", "c"]), (4, 1, ["d", "b"]), (5, 1, []), (6, 0, ["d"])]
    want = []
    for i, gold, tokens in rows:
        scores = {}
        for c in (0, 1):
            others = [t for j, g, ts in rows if g == c and j != i for t in ts]
            docs, v = sum(g == c and j != i for j, g, _ in rows), len({t for _, _, ts in rows for t in ts})
            scores[c] = sum(math.log((others.count(t) + 1) / (len(others) + v)) for t in tokens) + math.log((docs + 1) / (len(rows) - 1 + 2))
        want += [(i, gold, max(scores, key=lambda c: (round(scores[c], 6), -c)))] if tokens else []
    got = evaluate.naive_bayes_held_out(spark.createDataFrame(rows, "id long, gold int, tokens array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == want

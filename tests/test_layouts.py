import random

from pyspark.sql import functions as F

from provena.operators import build, layout, markup, views


def test_lanes_do_not_overlap_and_are_as_few_as_can_be(spark):
    random.seed(1)
    rows = [(v, n, float(random.choice(range(0, 400, 7)))) for v in range(3) for n in range(80)] + [(5, 1, 3.0), (5, 2, None)]
    got = layout.lanes(spark.createDataFrame(rows, "view int, id int, x double"), 30.0).collect()
    assert len(got) == len(rows) - 1
    for v in range(3):
        mine = sorted((r.x, r.lane) for r in got if r.view == v)
        for lane in {lane for _, lane in mine}:
            xs = [x for x, k in mine if k == lane]
            assert all(b - a > 30 for a, b in zip(xs, xs[1:]))
        assert max(k for _, k in mine) + 1 == max(sum(x - 30 <= y <= x for y, _ in mine) for x, _ in mine)


def test_rectangles_of_a_mark_become_runs_on_lines(spark):
    words = [(1, 0, 0, 10, 10), (1, 11, 1, 20, 9), (1, 12, -3, 14, 4), (1, 60, 0, 70, 10), (1, 0, 12, 30, 22), (2, 0, 0, 0, 5), (3, 5, 5, 6, 6), (3, 5, 5, 6, 6), (4, None, 0, 1, 1)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) if k else v for k, v in enumerate(w)) for w in words], "mark int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in layout.condense(df).collect())
    assert [g[0] for g in got].count(3) == 1 and not {2, 4} & {g[0] for g in got}
    assert (1, 0.0, 12.0, 30.0, 22.0) in [(g[0], *g[2:]) for g in got] and (60.0, 70.0) in [(g[2], g[4]) for g in got if g[0] == 1]
    assert layout.condense(df.limit(0)).count() == 0


def test_only_changed_papers_are_built_again(spark):
    schema = "paper int, key int, stance string, ordinal int"
    old = spark.createDataFrame([(1, 1, "extends", 1), (1, 1, "contests", 2), (2, 1, "compares", 1), (3, 1, "extends", 1)], schema)
    new = spark.createDataFrame([(1, 1, "contests", 2), (1, 1, "extends", 1), (2, 1, "compares", 1), (2, 2, "extends", 2), (4, 1, "inherits", 1)], schema)
    marked = build.build(old).withColumn("ordinal", F.col("ordinal") + 100)  # to see which rows are kept
    got = {(r.paper, r.key): (r.stance, r.ordinal) for r in build.rebuild(marked, new).collect()}
    assert got == {(1, 1): ("contests", 102), (2, 1): ("compares", 1), (2, 2): ("extends", 2), (4, 1): ("inherits", 1)}
    whole = {tuple(r) for r in build.build(new).collect()}
    assert {tuple(r) for r in build.rebuild(build.build(old), new).select(*build.build(new).columns).collect()} == whole
    twice = new.union(new.where("paper = 4"))
    assert build.states(twice).where("paper = 4").first().state != build.states(new).where("paper = 4").first().state


def test_a_swapped_paper_is_mismatched(spark):
    say = lambda p, n: f"In paper {p} sentence number {n} says something else"
    rows = [(p, n, say(p, n)) for p in range(4) for n in range(60)] + [(9, 0, "short")]
    pages = [(p, " ".join(say(p if p < 2 else p + 1, n) for n in range(60))) for p in range(3)]
    out = build.alignment(spark.createDataFrame(rows, "paper int, n int, text string"), spark.createDataFrame(pages, "paper int, text string")).collect()
    assert {r.paper: (r.n, r.rate, r.mismatched) for r in out} == {0: (40, 1.0, False), 1: (40, 1.0, False), 2: (40, 0.0, True), 3: (40, 0.0, True)}


def test_kinds_titles_and_checks(spark):
    titles = {"Model comparison": "results", "Model evaluation": "experiments", "Summary of related work": "related", "Approach and limitations": "limitations", "Our model": "method", "": "other"}
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.t: r.k for r in rows.select("t", markup.kind_of(F.col("t")).alias("k")).collect()} == titles
    said = {"Deep learning from preferences, 2017, 1706.03741": "Deep learning from preferences", "Space Odyssey 2001": "Space Odyssey 2001", "A title, in press": "A title", "A title. arXiv preprint arXiv:1901.01234v2, 2019.": "A title", "In press we trust": "In press we trust", " Plain ,": "Plain"}
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.c for r in rows.select("t", views.clean_title(F.col("t")).alias("c")).collect()} == said
    assert views.run_checks(rows, {}).count() == 0


def planned(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_lanes_take_no_python_call_for_each_view(spark):
    assert "Pandas" not in planned(layout.lanes(spark.createDataFrame([(1, 1, 0.0)], "view int, id int, x double"), 30.0))


def test_quotes_of_a_paper_meet_its_text_once(spark):
    pieces = spark.createDataFrame([(1, 1, "x")], "paper int, n int, text string")
    assert "collect_list" in planned(build.alignment(pieces, pieces.select("paper", "text")))


def test_papers_meet_as_numbers_and_sections_are_split_once(spark):
    from provena.plans import queries

    plan = planned(markup.sections(queries._papers(spark, "/root/testdata/sf0.001")))
    assert "concat" not in next(line for line in plan.split("\n") if "Aggregate" in line)
    assert "transform(regexp_extract_all" not in plan


def test_rows_of_a_page_do_not_hold_all_words_of_their_document(spark):
    from provena.plans.all import QUERIES

    assert "explode(sequence" not in planned(QUERIES["loc_page"](spark, "/root/testdata/sf0.001"))


def test_a_citation_command_is_read_once_for_all_its_keys(spark):
    from provena.plans import queries

    lines = planned(queries.cl_read(spark, "/root/testdata/sf0.001")).split("\n")
    first = lambda part: next(n for n, line in enumerate(lines) if part in line)
    assert first("Generate explode(split(keys") < first("background")
    text = r"\section{Method} Unlike \cite{a, ,b} and \citep[see]{c} this holds, as in ~\cite{d}. We extend \cite{a} here \x01 too. \cite{} is a short one without keys."
    rows = markup.citation_sites(spark.createDataFrame([(1, text.replace(r"\x01", "\x01")), (2, None), (3, r"\cite{short}")], "paper int, source string")).orderBy("ordinal", "key").collect()
    assert [(r.ordinal, r.key, r.before, r.after) for r in rows][:4] == [(1, "a", "Unlike", "and this holds, as in ."), (1, "b", "Unlike", "and this holds, as in ."), (2, "c", "Unlike and", "this holds, as in ."), (3, "d", "Unlike and this holds, as in", ".")]
    assert [(r.ordinal, r.key, r.after) for r in rows][4:] == [(4, "a", "here \x01 too.")] and {r.kind for r in rows} == {"method"}

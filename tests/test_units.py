import json

import pytest
from pyspark.sql import functions as F

from provena.functions import cues, numbers, text
from provena.operators import lineage, locate, markup, sessions
from provena.sources import records
from provena.plans.queries import QUERIES
from provena.streaming import events as stream

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("before", "after", "stance"),
    [
        ("Unlike ", ", our model is small.", "contests"),
        ("We do not use ", " in this work.", "background"),
        ("Following the recipe of ", " we fit our network.", "inherits"),
        ("In the years following for ", " we saw our growth.", "background"),
        ("It is shown, but we extend ", " here.", "extends"),
        ("We compare with ", " in Table 2.", "compares"),
        ("The model of ", " does not account for our noise.", "contests"),
        ("Many systems use ", " for speed.", "background"),
        ("We learn a shared space rather than to tell the parts of ", " apart.", "background"),
        ("We train a small network instead of ", ".", "contests"),
        ("Our loss is inspired by the idea of ", ".", "extends"),
        ("The network of ", " does not use a memory, and ours has one.", "background"),
        ("The network of ", " does not handle our long inputs.", "contests"),
        ("Unlike older ones, we use the optimiser of ", ".", "inherits"),
        ("Our scores are better than those of ", ".", "compares"),
        ("For decoding we rely on ", "'s implementation.", "background"),
    ],
)
def test_stance(spark, before, after, stance):
    assert one(spark, cues.read_stance(F.col("b"), F.col("a"), F.concat("b", "a")), b=before, a=after).stance == stance


@pytest.mark.parametrize(
    ("sentence", "kind"),
    [
        ("We assume that all of the samples are drawn independently.", "stated"),
        ("We do not assume that the samples are drawn independently.", None),
        ("Without loss of generality the first coordinate is positive.", "simplifying"),
        ("As is standard, the last layer is left out of all the sums.", "conventional"),
        ("We conjecture that the bound is tight for all larger values.", "conjectural"),
        ("We assume this.", None),
    ],
)
def test_assumption(spark, sentence, kind):
    got = one(spark, cues.read_assumption(F.col("s")), s=sentence)
    assert (got and got.kind) == kind


def test_digest_of_nothing_and_of_text(spark):
    assert one(spark, text.digest(F.col("s")), s="") == "ztntfp"
    h = 2166136261
    for c in "A sentence.":
        h = (h ^ ord(c)) * 16777619 % 2**32
    assert int(one(spark, text.digest(F.col("s")), s="A sentence."), 36) == h


def test_numbers_of_a_sentence(spark):
    got = one(spark, numbers.find_numbers(F.col("s")), s="In 2019 GPT-3 had 175B weights, 1,024 heads, −3.50% loss, 1.5e3 steps and .5 of 2401.12345")
    assert [(n.raw, float(n.value), n.decimals, n.is_percent) for n in got][:5] == [("175B", 175e9, 0, False), ("1,024", 1024.0, 0, False), ("−3.50%", -3.5, 2, True), ("1.5e3", 1500.0, 1, False), (".5", 0.5, 1, False)]
    assert one(spark, numbers.cell_number(F.col("s")), s="\\textbf{28.4}*").decimals == 1
    assert one(spark, numbers.cell_number(F.col("s")), s="28.4 of 30") is None
    assert float(one(spark, numbers.parse_decimal(F.col("s")), s="−1,234.50")) == -1234.5


def test_records(spark, tmp_path):
    lines = [json.dumps({"paper": "p", "key": "k", "gold": "extends"}), "", "# note", "{broken"]
    (tmp_path / "labels.jsonl").write_text("\n".join(lines))
    assert [r.gold for r in records.labels(spark, str(tmp_path / "labels.jsonl")).collect()] == ["extends"]
    cited = spark.createDataFrame([("see [1] now", 4.0, 7.0, "method"), ("x", float("nan"), 1.0, "method"), ("x", None, 1.0, "method"), ("x", 0.0, 9.0, "method"), ("abc", 0.0, 1.0, "other")], records.CITED)
    assert [(r.before, r.after) for r in records.cited_spans(cited, ["method"]).collect()] == [("see ", " now")]
    marked = spark.createDataFrame([("as @@CITATION says", "uses"), ("none", "uses")], records.MARKED)
    assert [(r.before, r.after, r.label) for r in records.marked_spans(marked).collect()] == [("as ", " says", "uses")]
    xml = '<d><sentence id="1">This <cue type="speculation">may</cue> be the cause of it.</sentence><sentence>Short.</sentence><sentence>It is <cue type="negation">not</cue> the cause of it all.</sentence></d>'
    assert [(r.text, r.uncertain) for r in records.hedged_sentences(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("This may be the cause of it.", True), ("It is not the cause of it all.", False)]


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><description>&lt;p&gt;Body&lt;/p&gt;</description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>No link</title></item></rss>"
    row = records.feed_items(spark.createDataFrame([("s", rss)], "source string, xml string")).collect()
    assert [(r.title, r.link, r.summary, r.published.day) for r in row] == [("A & B", "http://x/1", "Body", 5)]


def test_streamed_funnel_is_the_batch_funnel(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for n in range(3):  # a batch of the stream for each
        events.where(F.dayofmonth("ts") % 3 == n).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    stages = ["view", "click", "purchase"]
    changes = stream.run_available(stream.funnel(stream.read_events(spark, str(tmp_path)), stages, keep="60 days"), "update", "t")
    got = {r.session: r.reached for r in changes.groupBy("session").agg(F.max("reached").alias("reached")).collect()}
    want = {r.session: r.reached for r in sessions.reached(sessions.steps_of(events), stages).collect() if r.reached}
    assert got == want


def split_events(spark, folder):
    """The events as three files, read in this order: the last days, the first days, those between; the purchases of each before the rest."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    days = F.datediff(F.col("ts"), F.lit(events.agg(F.min("ts")).first()[0]))
    third = events.select((F.max(days) / 3).alias("n")).first().n
    parts = [days > 2 * third, days <= third, (days > third) & (days <= 2 * third)]
    for n, part in enumerate(parts):
        events.where(part & (F.col("event_type") == "purchase")).coalesce(1).write.parquet(f"{folder}/{2 * n}")
        events.where(part & (F.col("event_type") != "purchase")).coalesce(1).write.parquet(f"{folder}/{2 * n + 1}")


def test_streamed_queries_of_a_table_of_unordered_files(spark, tmp_path):
    split_events(spark, f"{tmp_path}/events.parquet")
    for name in ("st_sessions", "st_funnel_state", "st_tumbling_day"):
        got, want = (sorted(map(tuple, QUERIES[name](spark, folder).collect())) for folder in (str(tmp_path), SF))
        assert got == want, name
    steps = sessions.steps_of(spark.read.parquet(f"{SF}/events.parquet"))
    want = {(r.session, r.reached) for r in sessions.reached(steps, ["view", "click", "purchase"]).collect() if r.reached}
    assert set(map(tuple, QUERIES["st_funnel_state"](spark, str(tmp_path)).collect())) == want


def test_streamed_funnel_needs_no_python_for_a_session(spark):
    events = stream.read_events(spark, f"{SF}/events.parque[t]")
    assert "Pandas" not in stream.funnel(events, ["view", "click"])._jdf.queryExecution().analyzed().toString()


def test_streamed_funnel_takes_earlier_steps_in_later_batches(spark, tmp_path):
    stages = ["view", "click", "purchase"]
    events = spark.read.parquet(f"{SF}/events.parquet")
    for n, stage in enumerate(reversed(stages)):
        events.where(F.col("event_type") == stage).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    changes = stream.run_available(stream.funnel(stream.read_events(spark, str(tmp_path)), stages, keep="3650 days"), "update", "t")
    got = {r.session: r.reached for r in changes.groupBy("session").agg(F.max("reached").alias("reached")).collect()}
    assert got == {r.session: r.reached for r in sessions.reached(sessions.steps_of(events), stages).collect() if r.reached}


def test_numbers_out_of_range_and_typeset_exponents(spark):
    said = ["12345678901234567890123", "1.5e30", "1e-30", "3 × 10^5", "2.5e3", "−1,200.50", "7.5 %", "3.2M", "0e9"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(said)], "n int, t string")
    found = rows.select("n", numbers.find_numbers(F.col("t")).alias("f")).orderBy("n").collect()
    assert [len(r.f) for r in found] == [1] * len(said)
    values = [r.f[0].value for r in found]
    assert values[:3] == [None, None, None]
    assert [float(v) for v in values[3:]] == [300000.0, 2500.0, -1200.5, 7.5, 3200000.0, 0.0]
    assert [r.f[0].decimals for r in found][4:8] == [1, 2, 1, 1] and found[6].f[0].is_percent


def test_years_of_references_stand_in_no_identifier(spark):
    entry = r"\begin{document}\bibitem{a} A. One. \newblock A title. \newblock Venue, 1998. arXiv:1956.12345. \bibitem{b} B. Two. \newblock Other. \newblock Venue, 2003, 10.1000/1999.7 https://host/2011/x \end{document}"
    got = markup.references(spark.createDataFrame([(1, entry)], "paper int, source string")).collect()
    assert [(r.key, r.year, r.own_id) for r in sorted(got, key=lambda r: r.key)] == [("a", 1998, "1956.12345"), ("b", 2003, None)]


def test_paths_of_long_ids_and_quotes_of_an_empty_table(spark):
    ids = [123456781, 123456799, 1234567810, 5]
    edges = spark.createDataFrame([(ids[0], ids[1]), (ids[1], ids[2]), (ids[0], ids[3]), (ids[3], ids[2])], "src long, dst long")
    assert lineage.connect(edges, ids[0], ids[2]).collect()[0].path == "123456781>5>1234567810"
    docs = spark.createDataFrame([(1, "some text that is long enough")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert locate.locate(docs, none).count() == 0


def test_bounds_refreshes_and_claimed_titles(spark):
    from provena.operators import reading

    said = ["over ", "moreover ", "at  most", "better than ", "≥", "~ ", "", None, "up to five "]
    rows = spark.createDataFrame([(n, s) for n, s in enumerate(said)], "n int, s string")
    got = {r.n for r in rows.where(reading.is_bound(F.col("s"))).collect()}
    assert got == {0, 2, 3, 4, 5}
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    fresh = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v, r.stale) for r in reading.refresh(labels, fresh, ["k"], "v", "at").collect()) == [(1, "d", False), (2, "b", True), (3, "e", False)]
    titles = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id int, title string")
    attested = spark.createDataFrame([(1, "x"), (2, "y"), (9, "y")], "id int, title string")
    assert {r.id for r in reading.unclaimed(titles, attested).collect()} == {1, 3, 4}

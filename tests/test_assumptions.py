from provena.operators import assumptions


def test_assumptions_are_read_once_with_their_cue_and_what_backs_them(spark):
    text = r"""\newcommand{\fn}{convex}\begin{document}\section{Method}
We assume that the loss is \fn{} in all of its arguments \cite{boyd, smith}. We do not assume that anything else is known about it.
For simplicity we leave out the bias in all the layers, as shown in Figure~\ref{fig:bias}. \begin{equation}x\text{ We assume that equations are no prose at all.}\end{equation}
\section{Results} We assume that the loss is \fn{} in all of its arguments. Short, we assume.
\end{document}"""
    papers = spark.createDataFrame([(1, text), (2, ""), (3, None)], "paper int, source string")
    labels = spark.createDataFrame([(1, "fig:bias", "figure"), (1, "sec", "section")], "paper int, label string, kind string")
    rows = assumptions.extract(papers, labels).orderBy("section", "sentence").collect()
    assert [(r.kind, r.support, r.cites, r.refs) for r in rows] == [("simplifying", "shown", [], ["fig:bias"]), ("stated", "cited", ["boyd", "smith"], []), ("stated", "bare", [], [])]
    assert all(r.sentence[r.start : r.end] == r.cue for r in rows) and "convex in all" in rows[1].sentence
    assert assumptions.extract(papers.limit(0), labels).count() == 0


def test_agreement_of_cues_with_marks(spark):
    yes, no = "We assume that the part arrives on time in all of the cases.", "The part arrives on time in all of the cases that we have seen."
    rows = [("a", yes, True), ("a", yes, False), ("a", no, True), ("a", no, None), ("b", no, True), ("b", None, False)]
    got = {r.corpus: r for r in assumptions.agreement(spark.createDataFrame(rows, "corpus string, text string, uncertain boolean")).collect()}
    assert (got["a"].sentences, got["a"].gold, got["a"].flagged, got["a"].agreed, got["a"].precision, got["a"].recall, got["a"].f1) == (4, 2, 2, 1, 0.5, 0.5, 0.5)
    assert 0 < got["a"].low < 0.5 < got["a"].high < 1
    assert (got["b"].flagged, got["b"].precision, got["b"].low, got["b"].high, got["b"].f1) == (0, 0.0, 0.0, 0.0, 0.0)

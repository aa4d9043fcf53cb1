from provena.operators import archives, latex


def papers(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "paper int, source string")


def test_groups_match_like_brackets(spark):
    texts = ["{a{b}{c\\}d}}", "}} {x} {", "no braces", "", None, "\\\\{y}", "{" * 300 + "}" * 300]
    got = {(r.paper, r.start, r.end) for r in latex.groups(latex.tokens(papers(spark, *texts))).collect()}
    want = set()
    for n, text in enumerate(texts):
        k, open_ = 0, []
        while k < len(text or ""):
            if text[k] == "\\":
                k += 1
            elif text[k] == "{":
                open_.append(k)
            elif text[k] == "}" and open_:
                want.add((n, open_.pop(), k + 1))
            k += 1
    assert got == want and len(want) == 305


def test_definitions_of_every_kind(spark):
    text = r"\newcommand{\a}{x{y}} \newcommand\b[2][d{e}]{#1 and #2}\renewcommand*{\c}{\a\a}{\def\d#1{gone}}\DeclareMathOperator{\op}{op}\newenvironment{box}[1][1]{\begin{it}}{\end{it}} \definecolor{red}{x} \newcommand{\open{ never"
    rows = latex.definitions(papers(spark, text, "plain", None)).orderBy("n").collect()
    assert [(r.command, r.name, r.arity, r.body) for r in rows] == [("newcommand", "a", 0, "x{y}"), ("newcommand", "b", 2, "#1 and #2"), ("renewcommand", "c", 0, r"\a\a"), ("def", "d", 1, "gone"), ("DeclareMathOperator", "op", 0, "op"), ("newenvironment", "box", 1, r"\begin{it}")]
    left = latex.without_definitions(papers(spark, text, "plain", None)).orderBy("paper").collect()
    assert [r.source for r in left] == [r" {} \definecolor{red}{x} \newcommand{\open{ never", "plain", None]


def test_a_definition_does_not_reach_out_of_its_group(spark):
    assert latex.definitions(papers(spark, r"{\newcommand{\a}} {x}", r"{\newcommand{\a}[1} ] {x}", r"\newcommand{\a} word {x}")).count() == 0


def test_macros_of_numbers_and_of_macros(spark):
    text = papers(spark, r"\newcommand{\n}{$-1{,}234.5$}\newcommand{\x}{\n}\newcommand{\xx}{not \x}\newcommand{\x}{again \xx}" + r"A \x{} \xx. \n{}\n")
    assert [(r.name, float(r.value)) for r in latex.number_macros(text).collect()] == [("n", -1234.5)]
    out = latex.expand_macros(latex.without_definitions(text), latex.user_macros(text)).first().source
    assert out == r"A again not again not \x not again not again \xx. $-1{,}234.5$$-1{,}234.5$"
    assert latex.expand_macros(papers(spark, r"\y", None), latex.user_macros(text).where("false")).count() == 2


def test_environments_nest_by_name(spark):
    text = r"\begin{a}1\begin{b}2\begin{a}3\end{a}\end{a}\end{b}\end{a}\begin{a}open"
    got = sorted((r.name, text[r.body_start : r.body_end], r.depth) for r in latex.environments(papers(spark, text)).collect())
    assert got == [("a", r"1\begin{b}2\begin{a}3\end{a}", 0), ("a", "3", 1), ("b", r"2\begin{a}3\end{a}\end{a}", 0)]
    assert latex.without_environments(papers(spark, "x" + text, None), ("a", "b")).orderBy("paper").first().source == "x\n\n\\end{a}\\begin{a}open"


def test_archives_without_a_main_file_and_with_files_that_name_each_other(spark, monkeypatch):
    monkeypatch.setattr(archives, "DEEPEST", 4)
    rows = [("p", "a.tex", r"\begin{document}\documentclass 1\input{b}2\input{c}3"), ("p", "b.tex", r"[\input{c}]"), ("p", "c.tex", r"(\input{b}\input{a})"), ("q", "long.tex", "x" * 30), ("q", "short.tex", r"\input{long}"), ("r", "readme.md", "none"), ("s", "w.tex", r"\documentclass\begin{document}\includepdf{x}")]
    rows += [("deep", f"f{n}.tex", (r"\documentclass\begin{document}" if not n else "") + rf"{n} \input{{f{n + 1}}}") for n in range(7)]
    files = spark.createDataFrame(rows, "paper string, path string, text string")
    mains = archives.main_files(files)
    assert {(r.paper, r.path) for r in mains.collect()} == {("p", "a.tex"), ("q", "long.tex"), ("s", "w.tex"), ("deep", "f0.tex")}
    got = {r.paper: r.source for r in archives.with_inputs(files, mains).collect()}
    assert got["p"] == r"\begin{document}\documentclass 1[()]23"
    assert got["deep"].split()[1:] == [str(n) for n in range(1, archives.DEEPEST + 1)]
    assert {(r.paper, r.reason) for r in archives.load(files).collect()} == {("p", "too little prose"), ("q", "too little prose"), ("r", "no source"), ("s", "wraps a finished page"), ("deep", "too little prose")}
    assert archives.load(files.limit(0)).count() == 0


def test_a_place_found_late_but_read_first_has_the_file(spark):
    rows = [("p", "m.tex", r"\begin{document}\input{a}|\input{z}"), ("p", "a.tex", r"a\input{b}"), ("p", "b.tex", r"b\input{z}"), ("p", "z.tex", r"z\input{y}"), ("p", "y.tex", "y")]
    files = spark.createDataFrame(rows, "paper string, path string, text string")
    assert archives.with_inputs(files, archives.main_files(files)).first().source == r"\begin{document}abzy|"


def test_equations_beside_definitions_that_never_end(spark):
    open_ = r"\newcommand{\a}[1 \begin{equation}x_1\label{one} = #1 \newcommand*{\b}{\begin{align}gone\end{align}}\end{equation}" + r"\\newcommand{\c}{\begin{gather} a \label{x}\label{y} b \begin{gather}in\end{gather}\end{gather}}" + r"\def\d #1{\begin{math}kept\end{math}}\def\e#1#2{\begin{math}none\end{math}}\begin{math}ab\end{math}\end{math}\begin{math}open"
    got = [(r.ordinal, r.environment, r.latex, r.labels) for r in latex.equations(papers(spark, open_, None, "")).orderBy("ordinal").collect()]
    assert got == [(0, "gather", r"a  b \begin{gather}in\end{gather}", ["x", "y"]), (1, "math", "kept", [])]
    assert [(d[1], d[2], d[4]) for d in latex.find_definitions(open_)] == [("newcommand", "b", r"\begin{align}gone\end{align}"), ("def", "e", r"\begin{math}none\end{math}")]
    assert latex.find_definitions(r"\newcommand\a[{" * 20000) == latex.find_definitions("[" * 20000 + r"\def\x{" * 20000) == []

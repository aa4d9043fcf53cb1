"""Queries of LaTeX structure and of archives over sources written from the tables, with DuckDB SQL that never sees the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import archives, latex
from .queries import query, table

NUMBERED = "n AS (SELECT l_orderkey AS paper, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem), l AS (SELECT *, chr(CAST(96 + n AS INTEGER)) AS c FROM n)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, lines): the lines of an order, which are few, in order, as an array of (q, p)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = F.struct(F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").alias("p"))
    each = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.row_number().over(order).alias("n"), F.collect_list(line).over(every).alias("lines"))
    return each.where("n = 1").select("paper", "lines")


def _written(lines: DataFrame, **parts) -> DataFrame:
    """(paper, ...): each part's text of all lines, one after another; a part takes a line and its place from 0."""
    return lines.select("paper", *[F.array_join(F.transform("lines", part), "").alias(name) for name, part in parts.items()])


def _filled(template: str):
    """A template as a part of _written(), <q>, <p> and the letter <c> filled in."""

    def part(line: Column, place: Column) -> Column:
        out = F.lit(template)
        for name, value in (("q", line["q"].cast("string")), ("p", line["p"].cast("string")), ("c", F.char(place + 97))):
            out = F.replace(out, F.lit(f"<{name}>"), value)
        return out

    return part


# Definitions of three kinds by the line's number, with a comment, a definition by def, one of an environment, and one that never ends.
DEFINED = (r"\renewcommand*\w<c>{{nested \emph{<q>}} \} text}", r"\newcommand{\q<c>}{<q>}", r"\newcommand {\t<c>}[1][none {at all}]{two {of #1} \q<c>}")
REST = "% \\newcommand{\\no}{1}\n\\def\\d<c>#1#2{gone {too}}\n\\newenvironment{e<c>}[1]{begun {here}}{ended}\n"
USED = "Value \\q<c>{} and \\w<c>, \\t<c>{x} of \\qq end.\n"
DEFINED_SQL = r"CASE n % 3 WHEN 1 THEN q::VARCHAR WHEN 2 THEN 'two {of #1} \q' || c ELSE '{nested \emph{' || q || '}} \} text' END"
NAME_SQL = "CASE n % 3 WHEN 1 THEN 'q' WHEN 2 THEN 't' ELSE 'w' END || c"


def _macro_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    kinds = [_filled(d) for d in DEFINED]
    defined = lambda x, i: F.when((i + 1) % 3 == 0, kinds[0](x, i)).when((i + 1) % 3 == 1, kinds[1](x, i)).otherwise(kinds[2](x, i))
    text = _written(lines, head=lambda x, i: F.concat(defined(x, i), _filled(REST)(x, i)), body=_filled(USED))
    source = F.concat(F.lit("\\documentclass{article}\n\\newcommand{\\again}{\\again x}\n"), "head", F.lit("\\begin{document}\n"), "body", F.lit("{\\again}\n\\end{document}\n\\newcommand{\\bad}{never {closed}"))
    return text.select("paper", source.alias("source"))


def _plain(papers: DataFrame) -> DataFrame:
    return papers.withColumn("source", latex.without_comments(F.col("source")))


@query("SELECT p_partkey AS paper, i AS n, 2 + 3 * (i - 1) AS start, 4 + 3 * k + (k - i + 1) AS \"end\" FROM (SELECT p_partkey, p_size % 7 AS k FROM part), unnest(range(1, k + 1)) AS u(i)")
def fn_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 7
    source = F.concat(F.lit("} "), F.expr("repeat('{ab', p_size % 7)"), F.lit("\\}"), F.expr("repeat('}', p_size % 7)"), F.lit(" \\{ {"))
    papers = table(spark, sf_dir, "part").where(size > 0).select(F.col("p_partkey").alias("paper"), source.alias("source"))
    found = latex.groups(latex.tokens(papers))
    return found.select("paper", F.row_number().over(Window.partitionBy("paper").orderBy("start")).cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"WITH {NUMBERED} SELECT paper, {NAME_SQL} AS name, {DEFINED_SQL} AS body FROM l UNION ALL SELECT DISTINCT paper, 'again', '\\again x' FROM l")
def fn_allmacros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.all_macros(_plain(_macro_papers(spark, sf_dir))).select("paper", F.explode("macros").alias("name", "body"))


@query(f"WITH {NUMBERED} SELECT paper, {NAME_SQL} AS name, {DEFINED_SQL} AS body FROM l WHERE n % 3 <> 2 UNION ALL SELECT DISTINCT paper, 'again', '\\again x' FROM l")
def fn_usermacros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.user_macros(_plain(_macro_papers(spark, sf_dir))).select("paper", F.explode("macros").alias("name", "body"))


@query(f"WITH {NUMBERED} SELECT paper, {NAME_SQL} AS name, q AS value FROM l WHERE n % 3 = 1")
def fn_nummacros(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latex.number_macros(_plain(_macro_papers(spark, sf_dir)))
    return found.select("paper", "name", F.col("value").cast("long").alias("value"))


@query(f"""WITH {NUMBERED} SELECT paper, '\\documentclass{{article}}' || chr(10) || chr(10) || repeat(chr(10), 3 * count(*)) || '\\begin{{document}}' || chr(10) || string_agg('Value \\q' || c || '{{}} and \\w' || c || ', \\t' || c || '{{x}} of \\qq end.' || chr(10), '' ORDER BY n) || '{{\\again}}' || chr(10) || '\\end{{document}}' || chr(10) || '\\newcommand{{\\bad}}{{never {{closed}}' AS source FROM l GROUP BY paper""")
def fn_stripdefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.without_definitions(_plain(_macro_papers(spark, sf_dir)))


@query(f"""WITH {NUMBERED} SELECT paper, chr(10) || string_agg('Value ' || CASE WHEN n % 3 = 1 THEN q::VARCHAR ELSE '\\q' || c || '{{}}' END || ' and ' || CASE WHEN n % 3 = 0 THEN '{{nested \\emph{{' || q || '}}}} \\}} text' ELSE '\\w' || c END || ', \\t' || c || '{{x}} of \\qq end.' || chr(10), '' ORDER BY n) || '{{\\again x x x x}}' || chr(10) AS source FROM l GROUP BY paper""")
def fn_expandmacros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.document(_macro_papers(spark, sf_dir))


NESTED = "\\begin{wrap}x<q>\\begin{wrap}in\\end{wrap}\\begin {other}\\end {other}\\end{wrap} and\n"


def _nested_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _written(_lines(spark, sf_dir), body=_filled(NESTED))
    return text.select("paper", F.concat(F.lit("\\end{wrap}"), "body", F.lit("\\begin{wrap}never ended")).alias("source"))


@query(rf"""WITH {NUMBERED}, k AS (SELECT *, 10 + coalesce(sum(78 + length(q::VARCHAR)) OVER (PARTITION BY paper ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM l)
SELECT paper, unnest(['wrap', 'wrap', 'other']) AS name, unnest([z, z + 13 + length(q::VARCHAR), z + 37 + length(q::VARCHAR)])::BIGINT AS start, unnest(['x' || q || '\begin{{wrap}}in\end{{wrap}}\begin {{other}}\end {{other}}', 'in', '']) AS body, unnest([0, 1, 0]) AS depth FROM k""")
def fn_envspans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = latex.environments(_nested_papers(spark, sf_dir))
    return spans.select("paper", "name", F.col("start").cast("long").alias("start"), "body", F.when(F.col("name") == "wrap", F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))


@query(rf"WITH {NUMBERED} SELECT paper, '\end{{wrap}}' || repeat(chr(10) || chr(10) || ' and' || chr(10), count(*)) || '\begin{{wrap}}never ended' AS source FROM l GROUP BY paper")
def fn_blankenv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.without_environments(_nested_papers(spark, sf_dir), ("wrap", "other"))


@query(f"WITH {NUMBERED} SELECT paper, 2 * (n - 1) + unnest([0, 1]) AS ordinal, unnest(['equation', 'align*']) AS environment, unnest(['x_{{' || q || '}} = 1', 'a &= b \\\\ \\begin{{align*}} c \\end{{align*}}']) AS latex, unnest(['e' || c, '']) AS labels FROM l")
def fn_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _written(_lines(spark, sf_dir), body=_filled("\\newcommand{\\m<c>}{\\begin{equation}#1 and more\\end{equation}}\n\\begin{equation}\\label{e<c>} x_{<q>} = 1\\end{equation}\n\\begin{align*}a &= b \\\\ \\begin{align*} c \\end{align*}\\end{align*}\n\\begin{gather}z\\end{gather}% \\begin{equation}never\\end{equation}\n"))
    found = latex.equations(text.select("paper", F.col("body").alias("source")))
    return found.select("paper", F.col("ordinal").cast("long").alias("ordinal"), "environment", "latex", F.array_join("labels", ",").alias("labels"))


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the orders: a main file, parts that name each other down to the third level and back, a wrapper that the main file isn't, and notes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderkey").cast("string").alias("k"), (F.col("o_custkey") % 3).alias("kind"))
    prose = F.expr("repeat('Words of prose that stand in the text. ', cast(40 * kind as int))")
    main = F.concat(F.when(F.col("kind") == 1, "").otherwise("\\documentclass{article}\n"), F.lit("\\begin{document}A"), "k", F.lit("\\input{part1}B\\include{./missing}C\\input{part1.tex}D\\input {deep/x}"), prose, F.lit("\\end{document}"))
    files = F.array(
        F.struct(F.lit("main.tex").alias("path"), main.alias("text")),
        F.struct(F.lit("part1.tex").alias("path"), F.concat(F.lit("p"), "k", F.lit("[\\input{part2}]% \\input{never}")).alias("text")),
        F.struct(F.lit("part2.tex").alias("path"), F.lit("q{\\input{main}}{\\input{part2}}{\\input{part3}}").alias("text")),
        F.struct(F.lit("part3.tex").alias("path"), F.lit("r\\input{part1}").alias("text")),
        F.struct(F.lit("deep/x.tex").alias("path"), F.lit("x\\input{part3}").alias("text")),
        F.struct(F.lit("never.tex").alias("path"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("notes.txt").alias("path"), F.expr("repeat('\\\\documentclass\\\\begin{document}', 40)").alias("text")),
    )
    return orders.select("paper", F.explode(files).alias("f")).select("paper", "f.path", "f.text")


@query("SELECT o_orderkey AS paper, 'main.tex' AS path FROM orders")
def src_findmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.main_files(_archive(spark, sf_dir))


IN_ONE = "CASE WHEN o_custkey % 3 = 1 THEN '' ELSE '\\documentclass{article}' || chr(10) END || '\\begin{document}A' || o_orderkey || 'p' || o_orderkey || '[q{}{}{r}]BCDx' || repeat('Words of prose that stand in the text. ', CAST(40 * (o_custkey % 3) AS INTEGER)) || '\\end{document}'"


@query(f"SELECT o_orderkey AS paper, {IN_ONE} AS source FROM orders")
def src_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _archive(spark, sf_dir)
    return archives.with_inputs(files, archives.main_files(files))


@query(f"SELECT o_orderkey AS paper, {IN_ONE} AS source, CASE WHEN o_custkey % 3 = 0 THEN 'too little prose' END AS reason FROM orders")
def src_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.load(_archive(spark, sf_dir)).drop("prose_chars")

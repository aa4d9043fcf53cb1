"""Structure of LaTeX sources that no regular pattern can see: balanced groups, macro definitions, environments, equations. Papers are rows (paper, source).

A running sum of the braces gives each token its level, and the group that opens at a level ends at
the next brace that closes it. Offsets count characters from 0; ends are exclusive. A brace or an
environment that is never closed opens nothing. Definitions and environments are found in the row of
their source by one pass of a small helper, as rows of tokens are many times the source when they are shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_decimal
from .markup import body, without_comments

TOKEN = r"(?s)\\[A-Za-z@]+\*?|\\.|[{}\[\]]|[^\\{}\[\]]+|\\"
ENVIRONMENT = r"\\(begin|end)\s*\{([^{}]*)\}"
#: Commands that define macros; with those in the second row a source is rid of its definitions.
MACROS = ("newcommand", "renewcommand", "providecommand")
DEFINING = (*MACROS, "DeclareMathOperator", "def", "newtheorem", "declaretheorem", "newenvironment", "renewenvironment", "newcolumntype")
#: Environments of displayed mathematics.
MATH = ("equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "displaymath", "math")
#: How often macros are replaced in what replacing them gave; a macro that names itself ends there.
PASSES = 4
#: The fields of a definition.
DEFINITION = {"n": pa.int32(), "command": pa.string(), "name": pa.string(), "arity": pa.int32(), "body": pa.string(), "start": pa.int32(), "end": pa.int32()}
# What the helpers look for; blanks are those of Java's patterns.
_BLANK = " \t\n\x0b\f\r"
_TOKENS, _NAME = re.compile(TOKEN), re.compile(r"\{?\s*\\?([A-Za-z@*]+)", re.A)
_ARITY, _ENVIRONMENT = re.compile(r"\[\s*(\d)\s*\]", re.A), re.compile(ENVIRONMENT, re.A)
_DEFINED, _TEXT = re.compile(rf"\\({'|'.join(DEFINING)})(?![A-Za-z])(?:@[A-Za-z@]*)?\*?"), re.compile(r"[^\\{}\[\]]+")
_ESCAPED, _BRACKETS, _BLANKS = re.compile(r"\\[\\{}\[\]]"), re.compile(r"[{}\[\]]"), re.compile(f"[{_BLANK}]*")


def tokens(papers: DataFrame) -> DataFrame:
    """(paper, n, token, start, level): level is the number of groups open around the token; a brace stands in the group that it opens or ends."""
    each = papers.select("paper", F.posexplode(F.regexp_extract_all("source", F.lit(TOKEN), F.lit(0))).alias("n", "token"))
    upto = Window.partitionBy("paper").orderBy("n")
    start = F.sum(F.length("token")).over(upto) - F.length("token")
    opened = F.sum(F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)).over(upto)
    return each.select("paper", "n", "token", start.cast("int").alias("start"), (opened + (F.col("token") == "}").cast("int")).cast("int").alias("level"))


def _paired(marks: DataFrame, keys: list[str], opens: Column, order: str, *last: str) -> DataFrame:
    """marks that open something, with the columns last of the mark that closes it (closed_...): the next of the same keys, if that one closes."""
    following = Window.partitionBy(*keys).orderBy(order)
    closing = F.lead(F.when(~opens, F.struct(*last))).over(following)
    return marks.withColumn("__c", closing).where(opens & F.col("__c").isNotNull()).select(*marks.columns, *[F.col(f"__c.{c}").alias(f"closed_{c}") for c in last])


def groups(words: DataFrame) -> DataFrame:
    """(paper, level, n, start, end) of every balanced {...} among tokens(): the braces included."""
    braces = words.where(F.col("token").isin("{", "}"))
    return _paired(braces, ["paper", "level"], F.col("token") == "{", "n", "start").select("paper", "level", "n", "start", (F.col("closed_start") + 1).alias("end"))


def _closings(bare: str) -> tuple[dict, dict]:
    """Of a source without escapes, where each {, by its place, is closed, and where each [ is, by the next ] of its own group."""
    ends, after, outside, brackets = {}, {}, [], []
    for mark in _BRACKETS.finditer(bare):
        at, kind = mark.start(), mark[0]
        if kind == "{":
            outside.append((at, brackets))
            brackets = []
        elif kind == "[":
            brackets.append(at)
        elif kind == "]":
            for opened in brackets:
                after[opened] = at + 1
            brackets = []
        elif outside:
            opened, brackets = outside.pop()
            ends[opened] = at + 1
        else:
            brackets = []
    return ends, after


def _definitions(source: str) -> list[tuple]:
    """The definitions of one source in order: (command, name, arity, body, start, end). Only what follows a defining command is read, and all brackets once."""
    bare = _ESCAPED.sub("  ", source)
    commands = list(_DEFINED.finditer(bare))
    ends, after = _closings(bare) if commands else ({}, {})
    size, found = len(source), []
    skip = lambda at: _BLANKS.match(source, at).end()
    for command in commands:
        begin = skip(command.end())
        if begin in ends:
            at = ends[begin]
        elif source.startswith("\\", begin):
            at = _TOKENS.match(source, begin).end()
        else:
            continue
        name, arity, second = _NAME.search(source[begin:at]), 0, skip(at)
        if source.startswith("[", second):
            count = _ARITY.match(source, second, second + 8)
            arity = int(count[1]) if count else 0
            second = skip(after.get(second, size))
            if source.startswith("[", second):
                second = skip(after.get(second, size))
        elif command[1] == "def" and second == at and source.startswith("#", at):
            second = _TEXT.match(source, at).end()
            arity = source.count("#", at, second)
        if second not in ends:
            continue
        end = ends[second]
        last = ends.get(skip(end)) if command[1].endswith("environment") else None
        found.append((command[1], name[1] if name else "", arity, source[second + 1 : end - 1], command.start(), last or end))
    return found


def find_definitions(source: str) -> list[tuple]:
    """The definitions of one source, each a tuple of the fields of DEFINITION; n is the number of tokens before it."""
    found, n, upto = [], 0, 0
    for each in _definitions(source):
        n += len(_TOKENS.findall(source, upto, each[4]))
        upto = each[4]
        found.append((n, *each))
    return found


def _cut(source: str, spans: list[tuple[int, int]], filler: str) -> str:
    """source with filler in place of spans (start, end); spans that overlap are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [source[at:start], filler]
        at = max(at, end)
    return "".join(out) + source[at:]


def _part(sources: pa.Array) -> pa.Array:
    read = sources.to_pylist()
    found = [find_definitions(source) if source else [] for source in read]
    columns = list(zip(*[d for each in found for d in each], strict=True)) or [[]] * len(DEFINITION)
    fields = [pa.array(column, kind) for column, kind in zip(columns, DEFINITION.values(), strict=True)]
    ends = pa.array([0, *itertools.accumulate(map(len, found))], pa.int32())
    rest = pa.array([source and _cut(source, [d[-2:] for d in each], "") for source, each in zip(read, found, strict=True)], pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, list(DEFINITION))), rest], ["definitions", "rest"])


def _parted(source: str) -> Column:
    """The definitions of a source and what is left without them; as if by chance, so that plans don't read a source once for each use."""
    kind = "struct<definitions: array<struct<n: int, command: string, name: string, arity: int, body: string, start: int, end: int>>, rest: string>"
    return F.arrow_udf(_part, kind).asNondeterministic()(source)


def definitions(papers: DataFrame) -> DataFrame:
    """(paper, n, command, name, arity, body, start, end): a row for each definition whose body is a balanced group.

    A definition is its command, a name (in braces or bare), parameters in square brackets (or, of
    def, as #1#2) and a group; one of an environment has a second group. Each source is read where it
    stands: no token leaves its row.
    """
    return _read(papers).select("paper", F.inline("__parted.definitions"))


def _named_bodies(read: DataFrame, keep) -> DataFrame:
    """read (__parted, ..) with macros, a map of the bodies of the definitions to keep by name, of several the last; null without any."""
    kept = F.transform(F.filter("__parted.definitions", lambda d: d["command"].isin(*MACROS) & keep(d)), lambda d: F.struct(d["name"].alias("name"), d["n"].alias("n"), d["body"].alias("body")))
    sorted_ = read.withColumn("__kept", F.array_sort(kept))
    last = F.filter("__kept", lambda d, i: F.coalesce(F.get("__kept", i + 1)["name"] != d["name"], F.lit(True)))
    entries = F.map_from_entries(F.transform(last, lambda d: F.struct(d["name"], d["body"])))
    return sorted_.withColumn("macros", F.when(F.size("__kept") > 0, entries)).drop("__kept")


def _read(papers: DataFrame) -> DataFrame:
    return papers.withColumn("__parted", _parted("source"))


def all_macros(papers: DataFrame) -> DataFrame:
    """(paper, macros): the bodies of all its macros by name, of several definitions the last; papers without macros have no row."""
    return _named_bodies(_read(papers), lambda d: F.lit(True)).where("macros IS NOT NULL").select("paper", "macros")


def _without_argument(definition: Column) -> Column:
    return (definition["arity"] == 0) & ~definition["body"].contains("#")


def user_macros(papers: DataFrame) -> DataFrame:
    """(paper, macros): those of all_macros() that take no argument."""
    return _named_bodies(_read(papers), _without_argument).where("macros IS NOT NULL").select("paper", "macros")


def number_macros(papers: DataFrame) -> DataFrame:
    """(paper, name, value): macros whose whole body is a number, braces and dollar signs around it set aside."""
    each = user_macros(papers).select("paper", F.explode("macros").alias("name", "body"))
    return each.withColumn("value", parse_decimal(F.regexp_replace("body", r"[{}$\s]|\\xspace", ""))).where("value IS NOT NULL").select("paper", "name", "value")


def expanded(source: Column, macros: Column) -> Column:
    """source with every command of macros, a map of bodies by name, replaced by its body, and that again up to PASSES times."""
    out = source
    for _ in range(PASSES):
        parts = F.regexp_extract_all(out, F.lit(r"(?s)\\[A-Za-z@]+(?:\s*\{\})?|\\.|[^\\]+|\\"), F.lit(0))
        out = F.array_join(F.transform(parts, lambda t: F.when(t.startswith("\\"), F.coalesce(F.element_at(macros, F.regexp_extract(t, r"^\\([A-Za-z@]+)", 1)), t)).otherwise(t)), "")
    return F.when(macros.isNotNull(), out).otherwise(source)


def expand_macros(papers: DataFrame, macros: DataFrame) -> DataFrame:
    """papers with every command of its macros (paper, macros) replaced by its body, and that again up to PASSES times; an empty pair of braces after a command goes with it."""
    return papers.join(macros, "paper", "left").withColumn("source", expanded(F.col("source"), F.col("macros"))).drop("macros")


def expand_own_macros(papers: DataFrame) -> DataFrame:
    """expand_macros() with the papers' own user_macros(), without a join."""
    return _named_bodies(_read(papers), _without_argument).withColumn("source", expanded(F.col("source"), F.col("macros"))).drop("__parted", "macros")


def without_definitions(papers: DataFrame) -> DataFrame:
    """papers without their definitions, arguments and bodies included."""
    return papers.withColumn("source", _parted("source")["rest"])


def _environment_spans(source: str, names: tuple[str, ...] | None) -> list[tuple]:
    """(start, end, body start, body end, name, depth) of the environments of one source, in order."""
    levels, opened, found = {}, {}, []
    for mark in _ENVIRONMENT.finditer(source):
        name = mark[2]
        if names is not None and name not in names:
            continue
        level = levels.get(name, 0)
        if mark[1] == "begin":
            levels[name] = level + 1
            opened[name, level + 1] = mark.span()
        else:
            levels[name] = level - 1
            begin = opened.pop((name, level), None)
            if begin:
                found.append((begin[0], mark.end(), begin[1], mark.start(), name, level - 1))
    return sorted(found)


def find_environments(source: str, names: tuple[str, ...] | None = None) -> list[dict]:
    """The environments of one source as environments() has them, in order."""
    return [{"name": name, "start": start, "end": end, "body_start": first, "body_end": last, "depth": depth, "body": source[first:last]} for start, end, first, last, name, depth in _environment_spans(source, names)]


def find_displayed(source: str) -> list[tuple[str, str]]:
    """(name, body) of the outermost environments of MATH in one source without its definitions: those that begin after the ends of all before."""
    rest = _cut(source, [d[-2:] for d in _definitions(source)], "")
    found, furthest = [], 0
    for start, end, first, last, name, _ in _environment_spans(rest, MATH):
        if start >= furthest:
            found.append((name, rest[first:last]))
        furthest = max(furthest, end)
    return found


def _displayed(sources: pa.Array) -> pa.Array:
    found = [find_displayed(source) if source else [] for source in sources.to_pylist()]
    ends = pa.array([0, *itertools.accumulate(map(len, found))], pa.int32())
    fields = [pa.array([e[k] for each in found for e in each], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["name", "body"]))


def _environments(names: tuple[str, ...] | None) -> Callable[[str], Column]:
    return F.udf(lambda source: find_environments(source or "", names), "array<struct<name: string, start: int, end: int, body_start: int, body_end: int, depth: int, body: string>>", useArrow=True).asNondeterministic()


def environments(papers: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(paper, name, start, end, body_start, body_end, depth, body) of every environment, or those of the names; one inside another of its name ends where its own end stands, and depth counts those around it."""
    return papers.select("paper", _environments(names)("source").alias("e")).select("paper", F.inline("e"))


def without_environments(papers: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """papers with a paragraph break in place of each outermost environment of the names."""
    cut = F.udf(lambda source: source and _cut(source, [(e["start"], e["end"]) for e in find_environments(source, names)], "\n\n"), "string", useArrow=True)
    return papers.withColumn("source", cut("source"))


def equations(papers: DataFrame) -> DataFrame:
    """(paper, ordinal, environment, latex, labels) of displayed equations in order: outermost ones, without definitions' parameters, of 3 characters or more."""
    label = r"\\label\s*\{([^{}]*)\}"
    read = F.arrow_udf(_displayed, "array<struct<name: string, body: string>>").asNondeterministic()
    outer = papers.select("paper", read(without_comments(F.col("source"))).alias("outer"))
    labelled = lambda e: F.contains(e["body"], F.lit("\\label"))
    bare = lambda e: F.when(labelled(e), F.regexp_replace(e["body"], label, "")).otherwise(e["body"])
    labels = lambda e: F.when(labelled(e), F.regexp_extract_all(e["body"], F.lit(label), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.transform("outer", lambda e: F.struct(e["name"].alias("environment"), F.regexp_replace(bare(e), r"^\s+|\s+$", "").alias("latex"), labels(e).alias("labels")))
    kept = F.filter(found, lambda e: ~e["latex"].contains("#") & (F.length(e["latex"]) >= 3))
    return outer.select("paper", F.posexplode(kept).alias("ordinal", "e")).select("paper", "ordinal", "e.*")


def document(papers: DataFrame) -> DataFrame:
    """papers as they are read for prose: the body of the document without comments and definitions, with its own macros expanded."""
    clean = papers.withColumn("source", without_comments(F.col("source")))
    rest = _named_bodies(_read(clean), _without_argument).withColumn("source", body(F.col("__parted.rest")))
    return rest.withColumn("source", expanded(F.col("source"), F.col("macros"))).drop("__parted", "macros")

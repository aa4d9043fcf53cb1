"""Reading marked-up papers: comments, body, typed sections, sentences, citation sites, references. Papers are rows (paper, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of sections, the most specific first, and the beginnings of the words that name them; the first kind that a title names is its own.
KINDS = {
    "related": "related previous prior background literature", "limitations": "limitation broader ethic societal", "conclusion": "conclu summar future", "discussion": "discuss",
    "introduction": "introduc motivat overview", "experiments": "experiment evaluat setup training data implement", "results": "result ablation analys comparison finding",
    "method": "method model approach architect algorithm framework", "appendix": "appendi supplement",
}
#: Kinds that frame a paper, and kinds that come after its method.
FRAMING, AFTERWARDS = ("abstract", "introduction", "related"), ("experiments", "results", "discussion", "limitations", "conclusion", "appendix")
#: Words that end in a full stop without ending a sentence.
ABBREVIATIONS = """
al cf ed eds eg ie etc resp approx vs viz inc ltd co dept univ
fig figs eq eqs sec secs tab tabs ref refs app apps ch chs no nos vol vols pp
thm lem cor prop def defn rem alg
dr prof mr mrs ms st jr sr phd
jan feb mar apr jun jul aug sep sept oct nov dec
""".split()
CITE = r"\\(?:cite|citep|citet|citealp|citealt|citeauthor|citeyear)\*?(?:\[[^\]]*\])*\{([^}]*)\}"


def without_comments(source: Column) -> Column:
    return F.regexp_replace(source, r"(?m)%(?<!\\%).*$", "")


def body(source: Column) -> Column:
    """Between begin and end of the document; all of it if they are missing."""
    begin, end = "\\begin{document}", "\\end{document}"
    after = F.substr(source, F.instr(source, begin) + len(begin))
    inside = F.when(after.contains(end), F.substring_index(after, end, 1)).otherwise(F.regexp_extract(source, r"(?s)\\begin\{document\}(.*?)$", 1))
    return F.when(source.contains("\\begin{document}"), inside).otherwise(source)


def kind_of(title: Column) -> Column:
    """The most specific kind that a word of the title names; other where there is none."""
    named = [F.when(F.lower(title).rlike(rf"\b(?:{words.replace(' ', '|')})"), kind) for kind, words in KINDS.items()]
    return F.coalesce(*named, F.lit("other"))


def infer_method(typed: DataFrame) -> DataFrame:
    """Sections (paper, section, kind, ..) where those of no kind after the last framing one and before the first that follows a method are the method, if there is a framing one."""
    whole = Window.partitionBy("paper")
    ends = typed.withColumn("__end", F.min(F.when(F.col("kind").isin(*AFTERWARDS), F.col("section"))).over(whole))
    before = F.col("__end").isNull() | (F.col("section") < F.col("__end"))
    framed = ends.withColumn("__start", F.max(F.when(F.col("kind").isin(*FRAMING) & before, F.col("section"))).over(whole))
    own = (F.col("kind") == "other") & before & (F.col("section") > F.col("__start"))
    return framed.withColumn("kind", F.when(F.coalesce(own, F.lit(False)), "method").otherwise(F.col("kind"))).select(*typed.columns)


def sections(papers: DataFrame) -> DataFrame:
    """(paper, section, title, level, kind, text): the abstract first, nothing from the bibliography on; a subsection has the kind of the entry before it."""
    # Each step is a column of its own: an expression that a lambda names is read again for each of its elements.
    bare = papers.select("paper", without_comments(F.col("source")).alias("t"))
    text = F.regexp_replace(body(F.col("t")), r"(?s)\\(?:begin\{thebibliography\}|bibliography\{).*$", "")
    parted = bare.select("paper", text.alias("t")).select("paper", F.regexp_extract("t", r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1).alias("abstract"), F.regexp_replace("t", r"(?s)\\begin\{abstract\}.*?\\end\{abstract\}", "").alias("rest"))
    heads = F.regexp_extract_all("rest", F.lit(r"\\(?:sub)*section\*?\{[^}]*\}"), F.lit(0))
    head = r"\\(?:sub)*section\*?\{[^}]*\}"
    # Split at a mark, as split() compiles its pattern for each row.
    texts = F.when(F.contains("rest", F.lit("\x01")), F.split("rest", head, -1)).otherwise(F.split(F.regexp_replace("rest", head, "\x01"), "\x01", -1))
    rows = parted.select("paper", "abstract", heads.alias("heads"), texts.alias("texts"))
    found = F.zip_with("heads", F.slice("texts", F.lit(2), F.size("texts")), lambda h, t: F.struct(F.regexp_extract(h, r"\{([^}]*)\}", 1).alias("title"), F.when(h.startswith("\\section"), 1).otherwise(2).alias("level"), t.alias("text")))
    abstract = F.col("abstract")
    first = F.when(abstract != "", F.array(F.struct(F.lit("Abstract").alias("title"), F.lit(0).alias("level"), abstract.alias("text")))).otherwise(F.expr("cast(array() as array<struct<title:string,level:int,text:string>>)"))
    each = rows.select("paper", F.posexplode(F.concat(first, found)).alias("section", "s")).select("paper", "section", "s.*")
    own = F.when(F.col("level") == 0, F.lit("abstract")).when(F.col("level") == 1, kind_of(F.col("title")))
    inherited = F.last(own, ignorenulls=True).over(Window.partitionBy("paper").orderBy("section"))
    return each.withColumn("kind", F.coalesce(inherited, F.lit("other"))).select("paper", "section", "title", "level", "kind", "text")


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? before a capital or bracket, and at blank lines; not after an initial or a known abbreviation."""
    stops = r"(?<=[.!?])(?<!\b[A-Z]\.)(?<!\b(?:al|cf|eg|ie|vs|Fig|Eq|Sec|Tab)\.)(?<!e\.g\.)(?<!i\.e\.)\s+(?=[A-Z(\[\\])|\n\s*\n"
    # Split at a mark, as split() compiles its pattern for each row.
    pieces = F.when(text.contains("\x01"), F.split(text, stops)).otherwise(F.split(F.regexp_replace(text, stops, "\x01"), "\x01"))
    return F.filter(F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def merge_sentences(pieces: DataFrame) -> DataFrame:
    """(paper, n, sentence) from pieces (paper, block, n, piece) in order: a piece goes on with the one before it in its block if that ends in an abbreviation or an initial, and the first of a block with what leads in to it by a colon."""
    order = Window.partitionBy("paper").orderBy("block", "n")
    before, same = F.lag("piece").over(order), F.lag("block").over(order) == F.col("block")
    short = before.rlike(rf"(?:(?i:(?<![A-Za-z])(?:{'|'.join(ABBREVIATIONS)}))|\b[A-Z])\.[\"')\]]*\s*$")
    joins = F.coalesce(F.when(same, short).otherwise(before.rlike(r":\s*$")), F.lit(False))
    numbered = pieces.withColumn("__new", (~joins).cast("int")).withColumn("__s", F.sum("__new").over(order))
    each = numbered.groupBy("paper", "__s").agg(F.array_sort(F.collect_list(F.struct("block", "n", "piece"))).alias("p"))
    return each.select("paper", F.col("__s").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: F.trim(x["piece"])), " ").alias("sentence"))


def plain_prose(tex: Column) -> Column:
    """Markup off: citations and references gone, emphasised text kept, commands dropped."""
    blanks = lambda text: F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))  # noqa: E731  what is one space stays as it is
    out = F.when(tex.contains("\\cite"), F.regexp_replace(tex, CITE, " ")).otherwise(tex)
    out = F.regexp_replace(out, r"\\(?:ref|eqref|label|cref)\{[^}]*\}", " ")
    out = F.regexp_replace(out, r"\\(?:emph|textbf|textit|texttt)\{([^{}]*)\}", "$1")
    return F.when(tex.rlike(r"[\\{}~$]"), blanks(F.regexp_replace(out, r"\\[A-Za-z]+\*?|[{}~$]", " "))).otherwise(blanks(tex))


def citation_commands(papers: DataFrame) -> DataFrame:
    """(paper, section, kind, ordinal, keys, before, after, sentence): one row for each citation command in a sentence of 24 characters or more, keys as they are written."""
    each = sections(papers).select("paper", "section", "kind", F.posexplode(sentences(F.col("text"))).alias("n", "s")).where((F.length("s") >= 24) & F.contains("s", F.lit("\\cite")))
    # Split at a mark, as split() compiles its pattern for each row.
    parts = F.when(F.contains("s", F.lit("\x01")), F.split("s", CITE, -1)).otherwise(F.split(F.regexp_replace("s", CITE, "\x01"), "\x01", -1))
    cut = each.select("paper", "section", "kind", "n", plain_prose(F.col("s")).alias("sentence"), parts.alias("parts"), F.regexp_extract_all("s", F.lit(CITE), F.lit(1)).alias("commands"))
    commands = cut.select("paper", "section", "kind", "n", "sentence", "parts", F.posexplode("commands").alias("c", "keys"))
    order = Window.partitionBy("paper").orderBy("section", "n", "c")
    joined = commands.withColumn("ordinal", F.row_number().over(order)).withColumn("lead", F.array_join(F.slice("parts", 1, F.col("c") + 1), " ")).withColumn("rest", F.array_join(F.slice("parts", F.col("c") + 2, F.size("parts")), " "))
    return joined.select("paper", "section", "kind", "ordinal", "keys", plain_prose(F.col("lead")).alias("before"), plain_prose(F.col("rest")).alias("after"), "sentence")


def each_key(commands: DataFrame) -> DataFrame:
    """A row with key for each of the keys of citation_commands(); what they share is read before, once."""
    return commands.withColumn("key", F.explode(F.split("keys", ","))).withColumn("key", F.trim("key")).where("key <> ''").drop("keys")


def citation_sites(papers: DataFrame) -> DataFrame:
    """(paper, section, kind, ordinal, key, before, after, sentence): one row for each key of each citation command; keys of one command share its ordinal."""
    return each_key(citation_commands(papers)).select("paper", "section", "kind", "ordinal", "key", "before", "after", "sentence")


def references(papers: DataFrame) -> DataFrame:
    """(paper, key, authors, title, venue, year, own_id): the entries of the bibliography; blocks part authors, title and venue; the last year from 1950 to 2049 counts that stands in no identifier or address."""
    entries = F.filter(F.split(without_comments(F.col("source")), r"\\bibitem"), lambda e: e.rlike(r"^(?:\[[^\]]*\])?\{"))
    each = papers.select("paper", F.explode(entries).alias("e")).withColumn("e", F.regexp_replace("e", r"(?s)\\end\{thebibliography\}.*$", ""))
    blocks = F.transform(F.split(F.regexp_replace("e", r"^(?:\[[^\]]*\])?\{[^}]*\}", ""), r"\\newblock"), lambda b: F.regexp_replace(plain_prose(b), r"[.,\s]+$", ""))
    each = each.withColumn("blocks", blocks)
    prose = F.regexp_replace("e", r"(?i)https?://\S+|\b10\.\d{4,9}/\S+|arxiv[:\s/.a-z]*\d{4}\.\d{4,5}(?:v\d+)?", " ")
    years = F.regexp_extract_all(prose, F.lit(r"\b(?:19[5-9]|20[0-4])\d\b"), F.lit(0))
    identifier = F.nullif(F.regexp_extract("e", r"(?i)arxiv[:\s/.a-z]*(\d{4}\.\d{4,5})", 1), F.lit(""))
    return each.select("paper", F.regexp_extract("e", r"^(?:\[[^\]]*\])?\{([^}]*)\}", 1).alias("key"), F.get("blocks", F.lit(0)).alias("authors"), F.get("blocks", F.lit(1)).alias("title"), F.get("blocks", F.lit(2)).alias("venue"), F.try_element_at(years, F.lit(-1)).cast("int").alias("year"), identifier.alias("own_id"))

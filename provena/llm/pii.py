"""Personal data by weak supervision. DataFrame and SQL functions only.

Four kinds with a fixed pattern (email, ip, card, phone) are always spans. Looser candidates
(numbers that may be accounts, handles, long keys) get votes from regex, gazetteer and context
labelers. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic span classifier is then trained
on the candidates' own features with those likelihoods as soft labels, and decides.

The text is read once. Candidates stay in their document's row from the first pass to the last, so
nothing is joined or grouped by document; what is aggregated are counts of vote patterns and of
discrete feature vectors, both of bounded number.

Defined results: null counts as an empty text and has no spans; without candidates nothing is
added; repeated rows give repeated rows; an empty table gives an empty table; positions are code
points, ends exclusive; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kind, pattern, and what a text must have for the pattern to be tried. A match starts where a run
#: of its first class starts, or where the match before ended: the leftmost matches, in linear time.
BASE = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
CANDIDATES = (
    ("account", r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20./-]?[0-9]){6,}+(?![0-9A-Za-z])", r"[0-9](?:[\x20./-]?[0-9]){6}"),
    ("handle", r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.-])", "@"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}", r"[0-9A-Za-z+/_-]{16}"),
)
KINDS = tuple(k for k, _, _ in BASE + CANDIDATES)

#: Words that stand before personal numbers, names and keys in the corpus's languages, and words that stand before other numbers.
TRIGGERS = "password|passwd|pwd|passwort|contraseña|token|secret|api|apikey|key|clé|clave|schlüssel|account|konto|compte|cuenta|iban|ssn|passport|passeport|reisepass|tel|phone|téléphone|telefon|teléfono|fax|contact|twitter|instagram|follow|user|login"
OTHERS = "version|page|pages|isbn|issn|doi|issue|vol|section|chapter|figure|seite|número|total|price|commit|sha|md5|build"
KEY_PREFIXES = "AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|sk_|pk_|AIza|ya29|eyJ"
FOUND = "array<struct<m:string,before:string,after:string,s:int,e:int>>"
#: Rounds of expectation-maximisation, and the likelihood from which a candidate is a span.
ROUNDS, ACCEPT = 8, 0.5
VOTERS = ("pattern", "gazetteer", "trigger", "joint", "shape", "other")


def _once(value: Column, use) -> Column:
    """use(value), with value evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, gate: str) -> Column:
    """The pattern's matches in text with 32 characters before, 8 after and their positions; none where the gate isn't found."""

    def placed(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        triples = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(pieces, 1, n).alias("b"), F.slice(pieces, 2, n).alias("a"))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FOUND})").alias("out"))

        def add(state: Column, x: Column) -> Column:
            s = state["at"] + F.length(x["b"])
            e = s + F.length(x["m"])
            item = F.struct(x["m"].alias("m"), F.right(x["b"], F.lit(32)).alias("before"), F.left(x["a"], F.lit(8)).alias("after"), s.alias("s"), e.alias("e"))
            return F.struct(e.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

        return F.aggregate(triples, start, add, lambda state: state["out"])

    there = F.contains(text, F.lit(gate)) if len(gate) == 1 else text.rlike(gate)
    return F.when(there, _once(F.split(text, pattern, -1), placed)).otherwise(F.expr(f"cast(array() as {FOUND})"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: Column, x: Column) -> list[Column]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 none, in the order of VOTERS."""
    m, before, after = x["m"], F.lower(x["before"]), x["after"]
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    return [
        vote(m.rlike(r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{16,64}|[0-9]{3}-[0-9]{2}-[0-9]{4}|@[a-z][a-z0-9_]{3,14})$"), m.rlike(r"^[0-9]{4}([./-])[0-9]{2}\1[0-9]{2}$|^(?:[a-z]+[-_/]){1,8}[a-z0-9]+$")),
        vote(m.rlike(f"^(?:{KEY_PREFIXES})"), m.rlike(r"^(?:19|20)[0-9]{2}[ ./-]")),
        vote(before.rlike(f"(?:^|[^\\p{{L}}])(?:{TRIGGERS})[^\\p{{L}}]{{0,6}}$"), before.rlike(f"(?:^|[^\\p{{L}}])(?:{OTHERS})[^\\p{{L}}]{{0,6}}$")),
        vote(before.rlike("[=:\"'][ \"']*$"), before.rlike("[$€£%/][ ]?$") | after.rlike("^[ ]?[%€£$]")),
        vote((kind == 2) & m.rlike("[0-9].*[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z]"), (kind == 2) & ~m.rlike("[0-9].*[0-9].*[0-9]")),
        vote(F.lit(False), (kind == 0) & (m.rlike(r"[.][0-9]+[.]") | m.rlike(r"^[0-9]+[./][0-9]+$") | (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 13))),
    ]


def _features(kind: Column, x: Column) -> list[Column]:
    """Discrete features of a candidate for the span classifier; they are not the votes, but the text in and around it."""
    m, before = x["m"], x["before"]
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    flag = lambda c: c.cast("int")
    return [flag(kind == 0), flag(kind == 1), flag(kind == 2), F.least(F.length(m), F.lit(40)).cast("int") / F.lit(8), F.round(4 * digits / F.length(m)), flag(m.rlike("[A-Z]")), flag(m.rlike("[a-z]")), flag(m.rlike("[-_/. ]")), flag(before.rlike("[=:\"'][ \"']*$")), flag(F.lower(before).rlike(f"(?:{TRIGGERS})[^\\p{{L}}]{{0,6}}$")), flag(before.rlike("[0-9]"))]


N_FEATURES = 11


def found_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<struct<k,s,e>>, candidates array<struct<k,s,e,votes,features>>), in one pass over the text."""
    rows = documents.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")

    def spans_of(k: int, kind: str, pattern: str, gate: str) -> Column:
        valid = F.filter(matches(text, pattern, gate), lambda x: _valid(kind, x["m"]))
        return F.transform(valid, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    base = F.concat(*[spans_of(k, *rule) for k, rule in enumerate(BASE)])
    rows = rows.select("__id", base.alias("base"), *[matches(text, pattern, gate).alias(f"__c{k}") for k, (_, pattern, gate) in enumerate(CANDIDATES)])

    def judged(k: int) -> Column:
        kind = F.lit(k)
        apart = F.filter(f"__c{k}", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.transform(apart, lambda x: F.struct(F.lit(len(BASE) + k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*[v.cast("int") for v in _votes(kind, x)]).alias("votes"), F.array(*[f.cast("double") for f in _features(kind, x)]).alias("features")))

    return rows.select(F.col("__id").alias("id"), "base", F.concat(*[judged(k) for k in range(len(CANDIDATES))]).alias("candidates"))


def reliabilities(patterns: DataFrame) -> Column | None:
    """Likelihood of personal data given votes, as a column over votes; None without patterns.

    patterns: (votes, n). One aggregation for each round; its result, a share and two tables of
    three numbers for each labeler, goes into the next round as literals.
    """
    votes = F.col("votes")
    now = 1 / (1 + F.exp(1.0 - 2.0 * F.aggregate(votes, F.lit(0), lambda a, v: a + v)))  # without a vote, unlikely
    values = (-1, 0, 1)
    for _ in range(ROUNDS):
        p = now * F.col("n")
        row = patterns.agg(
            F.sum("n").alias("n"), F.sum(p).alias("yes"),
            *[F.sum(F.when(votes[j] == v, p).otherwise(0.0)).alias(f"y{j}_{v + 1}") for j in range(len(VOTERS)) for v in values],
            *[F.sum(F.when(votes[j] == v, F.col("n")).otherwise(0)).alias(f"a{j}_{v + 1}") for j in range(len(VOTERS)) for v in values],
        ).first()
        if not row["n"]:
            return None
        yes, no = row["yes"] + 1.0, row["n"] - row["yes"] + 1.0
        odds = F.log(F.lit(yes / no))
        for j in range(len(VOTERS)):
            said = [F.lit((row[f"y{j}_{v + 1}"] + 1.0) / (yes + 2)) / F.lit((row[f"a{j}_{v + 1}"] - row[f"y{j}_{v + 1}"] + 1.0) / (no + 2)) for v in values]
            odds = odds + F.log(F.when(votes[j] == -1, said[0]).when(votes[j] == 0, said[1]).otherwise(said[2]))
        now = 1 / (1 + F.exp(-odds))
    return now


def classifier(candidates: DataFrame, likelihood: Column) -> tuple[float, list[float]]:
    """Intercept and weights of the logistic classifier, fitted on counts of feature vectors with their summed likelihoods."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    sums = candidates.groupBy("features").agg(F.sum(likelihood).alias("yes"), F.sum(1 - likelihood).alias("no"))
    both = sums.select(array_to_vector("features").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight")))).alias("x"))
    rows = staged(both.select("features", "x.label", "x.weight").where("weight > 1e-9").repartition(1), "pii-soft-labels")
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    return float(model.intercept), [float(w) for w in model.coefficients]


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of struct<k,s,e>, k a place in KINDS; spans holds base and the classifier's, by kind, then start."""
    rows = staged(found_spans(documents, id_col, text_col), "pii-candidates")
    each = rows.select(F.explode("candidates").alias("c")).select("c.votes", "c.features")
    patterns = staged(each.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    likelihood = reliabilities(patterns)
    bare = lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))
    if likelihood is None:
        added = F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")
    else:
        intercept, weights = classifier(each, likelihood)
        score = lambda c: reduce(lambda a, b: a + b, [F.lit(intercept)] + [F.lit(w) * c["features"][j] for j, w in enumerate(weights)])
        added = F.transform(F.filter("candidates", lambda c: 1 / (1 + F.exp(-score(c))) >= ACCEPT), bare)
    return rows.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", added)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(names[x["k"]], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")

"""What a sentence does with the work it cites, and what it takes on faith: cue tables as data, guards as column expressions.

Input are the text before and after a citation and the whole sentence, without markup. Patterns are
tried family by family; within a family the first surviving match decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases before a citation, by what they say of the cited work; families are tried in this order. A tilde stands for any ending.
OPPOSED = """unlike; in contrast to; in contrast with; contrary to; in opposition to; differ from; differs from; diverge~ from; depart~ from; whereas;
we dispute~; we challenge~; we question~; correct~ the claim; correct~ the result; correct~ the error; contradict~; disagree~ with"""
CONTRASTED = "rather than; instead of; as opposed to; in lieu of"
EXTENDED = """we extend~; we generalis~; we generaliz~; we adapt~; we refine~; we strengthen~; we revisit~; build~ on; build~ upon; extend~ the work; extend~ the approach;
extend~ the method; extend~ the result; inspired by; motivated by; improve~ on; improve~ upon; starting from; starting with"""
TAKEN_OVER = """following; as in; as done in; as done by; as described in; as described by; as proposed in; as proposed by; as introduced in; as introduced by;
we use~; we adopt~; we follow~; we employ~; we apply; we applied; we reuse~; we take; we took; we borrow~; we keep; we retain~; we look at; we evaluate on; we train on; we test on; we report on;
identical to; the same as; taken from; borrowed from; based on; built on top of; built upon top of; implementation of; implemented in; implemented by; implemented using;
standard practice; standard setup; standard recipe; standard approach; standard method; standard algorithm; standard implementation; standard technique; standard procedure; standard architecture; standard benchmark;
using; employing; adopting; applying; reimplement~; re-implement~"""
MEASURED = """compare to; compare with; compare against; compared to; compared with; compared against; we compare~; in comparison to; in comparison with; outperform~; outscore~;
baseline~; versus; vs; better than; worse than; on par with; competitive with"""
#: What a citation that is the subject may fall short in, after a negation, and phrases that say so alone.
SHORT_OF = "account; generalis~; generaliz~; handle; address; consider; scale; apply; hold; extend; capture; support; work"
LACKING = """cannot; can not be applied; can not be extended; can not be used; fail~ to; neglect~; overlook~; ignore~; omit~; is limited; is restricted; is incorrect; is wrong; is unable;
are limited; are restricted; are incorrect; are wrong; are unable; suffer~ from; struggle~ to; struggle~ with; break~ down"""
#: What of a cited work is taken over when it stands in the genitive.
OWNED = "approach; method; architecture; setup; recipe; code; implementation; hyperparameter~; hyper-parameter~"
NEGATOR = r"(?:\bnot|\bno|\bnever|n't|\bwithout|\bcannot)\s+(?:\w+\s+)?$"


def phrases(listed: str) -> str:
    """A pattern for any of the phrases of a list; white space may be any, a tilde any ending."""
    words = [w.strip() for w in listed.replace("\n", " ").split(";")]
    return "|".join(r"\s+".join(words_.split()).replace("~", r"\w*") for words_ in sorted(words, key=len, reverse=True))


BEFORE = (("contests", phrases(OPPOSED)), ("contests", phrases(CONTRASTED)), ("extends", phrases(EXTENDED)), ("inherits", phrases(TAKEN_OVER)), ("compares", phrases(MEASURED)))
AFTER = (
    ("contests", rf"(?:does|do|did)\s+not\s+(?:{phrases(SHORT_OF)})|{phrases(LACKING)}"),
    ("extends", rf"which\s+(?:{phrases('we extend~; we generalis~; we generaliz~; we adapt~')})"),
    ("inherits", rf"['’]s\s+(?:{phrases(OWNED)})"),
)
#: Words that open a statement of their own after a comma: conjunctions that join clauses, relatives, and pronouns and possessives that can be its subject. Only a subject stays part of the new clause.
CONJUNCTIONS = "although and because but if once since so that though unless until when whenever where whereas while yet".split()
RELATIVES = "that which who whom whose".split()
SUBJECTS = "he her his i it its my our she their these they this those we you your".split()
STOPS = (";", "—", "--", r"[.!?]\s")
CLAUSE_BREAK = rf"(?i)(?:{'|'.join(STOPS)})\s*|,\s+(?:{'|'.join(sorted({*CONJUNCTIONS, *RELATIVES}))})\s+|,\s+(?=(?:{'|'.join(SUBJECTS)})\s)"
FIRST_PERSON = r"\b(?:we|our|us|this (?:paper|work|study|article)|here)\b"
#: Kinds of assumptions in the order in which they are tried.
ASSUMPTIONS = (
    ("stated", r"\b(?:we|one) (?:will |shall |can |may )?assumes?\b|\bunder the assumption\b|\bassumption that\b|\bassuming\b"),
    ("simplifying", r"\bfor simplicity\b|\bwithout loss of generality\b|\bfor (?:ease|convenience)\b|\bwe (?:ignore|neglect)\b"),
    ("conventional", r"\bas is (?:standard|common|usual)\b|\bby convention\b|\bit is (?:common|customary|standard)\b"),
    ("conjectural", r"\bwe (?:conjecture|hypothesi[sz]e|believe|expect|suspect)\b|\bpresumably\b"),
    ("conditional", r"\bprovided that\b|\bas long as\b|\bif and only if\b|\bgiven that\b"),
)


def clause(before: Column) -> Column:
    """The last 140 characters before the site, after their last clause break."""
    marked = F.regexp_replace(F.replace(F.right(before, F.lit(140)), F.lit("\x01"), F.lit("\x02")), CLAUSE_BREAK, "\x01")
    return F.substring_index(marked, "\x01", -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cues(text: Column, pattern: str) -> Column:
    """Matches of a family in order, each with the text before and after it; null where there is none."""
    word = rf"(?i)\b(?:{pattern})\b"
    found = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    # Split at a mark in place of each match, as split() compiles its pattern for each row.
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("\x02")), word, "\x01"), "\x01", -1)
    each = _let(pieces, lambda p: F.transform(found, lambda m, n: F.struct(m.alias("cue"), F.get(p, n).alias("lead"), F.get(p, n + 1).alias("rest"))))
    return F.when(text.rlike(word), each)


def _first(text: Column, pattern: str) -> Column:
    """The first cue that no negator precedes and that, if it is 'following', no preposition follows."""
    alive = F.filter(_cues(text, pattern), lambda m: ~F.right(m["lead"], F.lit(24)).rlike(f"(?i){NEGATOR}") & ~((F.lower(m["cue"]) == "following") & m["rest"].rlike(r"^\s+(?:for|in|of)\b")))
    if pattern == phrases(CONTRASTED):  # it is the work that is contrasted only if nothing but a few words of a name lie between, and no deed
        alive = F.filter(alive, lambda m: m["rest"].rlike(r"^\s*(?:[\w'’-]+\s+){0,4}$") & ~m["rest"].rlike(r"(?i)^\s*(?:to\b|\w+ing\b)"))
    return F.get(F.transform(alive, lambda m: m["cue"]), F.lit(0))


def read_stance(before: Column, after: Column, sentence: Column) -> Column:
    """struct<stance, cue> of a citation; background with an empty cue where nothing speaks."""

    def read(said: Column) -> Column:
        options = []  # functions of a column are called as the expression is built, inside their loop
        for stance, pattern in BEFORE:
            speaks = lambda cue: F.when(cue.isNotNull() & (said["us"] | F.lower(cue).startswith("we ")), F.struct(F.lit(stance).alias("stance"), cue.alias("cue")))  # noqa: B023, E731
            options.append(_let(_first(said["here"], pattern), speaks))
        for stance, pattern in AFTER:
            cue = F.nullif(F.regexp_extract(said["behind"], rf"(?i)^\W*?(?:\w+\W+){{0,3}}?({pattern})\b", 1), F.lit(""))
            speaks = lambda cue: F.when(cue.isNotNull() & ~said["here"].rlike(f"(?i){FIRST_PERSON}"), F.struct(F.lit(stance).alias("stance"), cue.alias("cue")))  # noqa: B023, E731
            options.append(_let(cue, speaks))
        return F.coalesce(*options, F.struct(F.lit("background").alias("stance"), F.lit("").alias("cue")))

    return _let(F.struct(clause(before).alias("here"), F.substring(after, 1, 140).alias("behind"), sentence.rlike(f"(?i){FIRST_PERSON}").alias("us")), read)


def read_assumption(sentence: Column) -> Column:
    """struct<kind, cue> of a sentence of 40 characters or more, null if it assumes nothing; a negated cue is none."""

    def read(said: Column) -> Column:
        options = []
        for kind, pattern in ASSUMPTIONS:
            cues = F.filter(_cues(said, pattern.replace(r"\b", "")), lambda m: ~F.right(m["lead"], F.lit(20)).rlike(f"(?i){NEGATOR}"))
            if kind == "conditional":
                cues = F.filter(cues, lambda m: ~m["rest"].rlike(r"^\s*[\d.]"))
            options.append(_let(F.get(F.transform(cues, lambda m: m["cue"]), F.lit(0)), lambda cue: F.when(cue.isNotNull(), F.struct(F.lit(kind).alias("kind"), cue.alias("cue")))))
        return F.when(F.length(F.trim(said)) >= 40, F.coalesce(*options))

    return _let(sentence, read)


def support(has_cite: Column, has_evidence: Column) -> Column:
    """How an assumption is backed: cited, shown in the paper, or bare."""
    return F.when(has_cite, "cited").when(has_evidence, "shown").otherwise("bare")

"""License scans by template-markup matching.

A template is license wording with markup: ``[[...]]`` is an optional region, ``{{n}}`` a
replaceable region of up to n words, everything else mandatory. Each template is compiled into an
automaton over words whose arcs read one given word or any word; a text is accepted at a place
where the automaton reaches its end, so mandatory wording matches word for word. Places to try
come from an anchor, a run of mandatory words that every accepted text holds.

Words are maximal runs of ASCII letters (lower-cased), digits and non-ASCII characters.

Defined results: a null or empty text has no words and no places; a text with repeated notices
counts every place; repeated rows give repeated rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch

#: Phrase and label of plain phrases, which count wherever their words stand together.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, anchor and template. Wording is that of the public license notices.
TEMPLATES = (
    ("apache-2.0", "apache license", "[[this work is]] licensed under the apache license [[version]] 2 0 [[the license]]"),
    ("apache-2.0", "you may not use this file except", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "mit license", "[[this {{2}} is]] [[the]] {{1}} [[released under]] [[licensed under]] the mit license"),
    ("mit", "permission is hereby granted free of charge", "[[copyright [[c]] {{8}}]] permission is hereby granted free of charge to any person obtaining a copy of this {{2}} and associated documentation files [[the software]] to deal in the {{1}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{1}}"),
    ("bsd", "redistribution and use in source and binary forms", "[[copyright [[c]] {{8}}]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd license", "[[released]] [[licensed]] under [[the]] [[{{1}} clause]] bsd license"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2.0", "general public license", "[[this {{2}} is]] licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "general public license", "[[this {{2}} is]] licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("lgpl", "lesser general public license", "licensed under [[the terms of]] the gnu lesser general public license [[version {{2}}]]"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "[[this {{2}} is]] licensed under [[a]] [[creative commons]] cc by nc [[4 0]]"),
    ("cc-by-sa", "cc by sa", "[[this {{2}} is]] licensed under [[a]] [[creative commons]] cc by sa [[4 0]]"),
    ("cc-by-4.0", "cc by 4 0", "[[this {{2}} is]] licensed under [[a]] [[creative commons]] cc by 4 0"),
    ("cc0", "cc0", "[[this {{2}} is]] [[licensed]] [[released]] under cc0 [[1 0]]"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "[[copyright [[c]] {{8}}]] all rights reserved"),
)

#: Lower-cases A-Z and turns every byte that is in no word into a space.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Automaton:
    label: str
    anchor: bytes
    #: Of each state: (word or None for any, next state).
    arcs: tuple[tuple[tuple[bytes | None, int], ...], ...]
    #: Of each state: the states reached without reading.
    free: tuple[frozenset[int], ...]
    mandatory: int
    longest: int


def compile_template(label: str, anchor: str, markup: str) -> Automaton:
    """The automaton of a template; state 0 begins, the last state accepts."""
    arcs: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[set[int]] = [set()]
    opened: list[int] = []
    mandatory = longest = 0

    def add() -> int:
        arcs.append([])
        free.append(set())
        return len(arcs) - 1

    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        here = len(arcs) - 1
        if part == "[[":
            opened.append(here)
            free[here].add(add())
        elif part == "]]":
            end = add()
            free[here].add(end)
            free[opened.pop()].add(end)
        elif part.startswith("{{"):
            for _ in range(int(part[2:-2])):
                at = len(arcs) - 1
                after = add()
                arcs[at].append((None, after))
                longest += 1
            for state in range(here, len(arcs) - 1):
                free[state].add(len(arcs) - 1)
        else:
            arcs[here].append((part.encode(), add()))
            longest += 1
            mandatory += not opened
    closed = []
    for state in range(len(arcs)):
        seen, todo = {state}, [state]
        while todo:
            for other in free[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        closed.append(frozenset(seen))
    return Automaton(label, f" {anchor} ".encode(), tuple(map(tuple, arcs)), tuple(closed), mandatory, longest)


def longest_match(automaton: Automaton, words: list[bytes], start: int) -> int:
    """Words read by the longest accepted run that begins at start, 0 where there is none."""
    states, best, final = set(automaton.free[0]), 0, len(automaton.arcs) - 1
    for n in range(start, min(len(words), start + automaton.longest)):
        states = {s for q in states for word, to in automaton.arcs[q] if word is None or word == words[n] for s in automaton.free[to]}
        if not states:
            break
        if final in states:
            best = n - start + 1
    return best


@lru_cache(maxsize=4)
def automata(templates: tuple = TEMPLATES) -> tuple[Automaton, ...]:
    return tuple(compile_template(*t) for t in templates)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Byte positions of a phrase with a space on either side; places may share words."""
    found, at = [], line.find(phrase)
    while at >= 0:
        found.append(at)
        at = line.find(phrase, at + 1)
    return found


def template_matches(line: bytes, templates: tuple[Automaton, ...]) -> list[tuple[str, int, int, int]]:
    """(label, first word, words read, mandatory words of the template) of the longest accepted run over each anchor.

    Runs are tried only within the template's length of an anchor, and words are split only there, so a long text costs no more than its anchors.
    """
    out = []
    for automaton in templates:
        reach, done = automaton.longest, -1
        for at in places(line, automaton.anchor):
            if at < done:
                continue  # read by the run before
            before = line[:at].rsplit(b" ", reach)[1:] if line[:at].strip() else []
            before = [w for w in before if w]
            words = before + line[at:].split(None, reach)[:reach]
            best = max(((n, -start) for start in range(len(before) + 1) if (n := longest_match(automaton, words, start)) + start > len(before)), default=None)
            if best:
                n, start = best[0], -best[1]
                out.append((automaton.label, line.count(b" ", 0, at) - len(before) + start, n, automaton.mandatory))
                done = at + sum(map(len, words[len(before) : start + n])) + (start + n - len(before))
    return out


SCAN = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:int,words:int>>"
MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each row of df with the columns of SCAN.

    base: places of the phrases; labels: theirs and the accepted templates'. score: 0 without a
    label; 0.5 with phrases only; else 0.5 to 1, with the mandatory words of the longest accepted template.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compiled = automata(templates)
        needles = [(f" {p} ".encode(), label) for p, label in phrases]
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = (text or b"").translate(WORD_BYTES).split()
            line = b" " + b" ".join(words) + b" " if words else b""
            starts, base = [], set()
            for needle, label in needles:
                for at in places(line, needle):
                    starts.append(line.count(b" ", 0, at))
                    base.add(label)
            accepted = template_matches(line, compiled) if line else []
            labels = base | {m[0] for m in accepted}
            score = 0.5 * bool(labels) + 0.5 * (1 - 0.5 ** (max((m[3] for m in accepted), default=0) / 4)) if labels else 0.0
            rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": m[0], "start": m[1], "words": m[2]} for m in accepted]))
        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", MATCH)]
        return record_batch(id=batch.column(0), **{name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, SCAN).withColumnRenamed("id", id_col)

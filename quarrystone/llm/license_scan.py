"""License scans by template-markup matching.

A template is license wording with markup: ``<<beginOptional>>`` and ``<<endOptional>>`` around what may be absent (they nest), and
``<<var;match=.{a,b}>>`` where any a to b words may stand (``.+`` and ``.*`` have no upper bound).  Case, punctuation and white space don't count.  A
template is compiled to an automaton over words: each place consumes one word, and tells which places may follow; optional
and replaceable regions become further successors.  A text is accepted where the automaton runs from its first to a last place within it,
that is, where all mandatory wording stands exactly and in order.  The longest run of mandatory words must be in a text
literally, so only texts that hold it are run at all; this loses nothing.

Apart from templates, phrases are counted at every place where their words stand consecutively, and label the text.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned each; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrystone.llm.shared import id_and_text

#: The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license wording with its optional and replaceable parts, by label.  Fixed values.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license<<beginOptional>>,<<endOptional>> version 2.0",
    "bsd": """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<var;match=.{0,2}>> redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;match=.{0,2}>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "cc-by-nc-4.0": """licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>creative commons <<endOptional>>cc
        by-nc 4.0<<beginOptional>> international<<endOptional>>""",
    "gpl-3.0": """licensed under <<beginOptional>>the terms of <<endOptional>>the gnu general public license<<beginOptional>> as published by the free software
        foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version 3<<beginOptional>>, or (at your option) any later version<<endOptional>>""",
    "isc": """permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit": """<<beginOptional>>copyright <<var;match=.{1,20}>> <<endOptional>>permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files<<beginOptional>> (the "software")<<endOptional>>, to deal in the software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the
        software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice<<beginOptional>> (including
        the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the software.""",
    "mit-notice": "<<beginOptional>>this <<var;match=.{1,5}>> is <<endOptional>>released under the<<beginOptional>> terms of the<<endOptional>> mit license",
}

#: A-Z to a-z, and every other ASCII character but letters and digits to a space.  All bytes above stay, so code points stay whole.
_KEPT = bytes(range(48, 58)) + bytes(range(97, 123))
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")
_AMOUNT = re.compile(r"match=\.(?:(\+)|(\*)|\{(\d+),(\d+)\})")
#: A place that consumes any word.
ANY = None


def words_of(text: str) -> list[str]:
    return text.encode().translate(_WORDS).decode().split()


def regions(template: str) -> list:
    """A template as a list: words, optional regions as lists, replaceable ones as (least, most), where most may be None.

    ``ValueError`` tells of markup that is unknown or not closed.
    """
    open_lists: list[list] = [[]]
    at = 0
    for mark in _MARKUP.finditer(template):
        open_lists[-1] += words_of(template[at : mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            open_lists.append([])
        elif mark[1] == "endOptional":
            if len(open_lists) == 1:
                raise ValueError("an optional region ends that didn't begin")
            inner = open_lists.pop()
            open_lists[-1].append(inner)
        elif amount := _AMOUNT.search(mark[1]):
            plus, star, least, most = amount.groups()
            open_lists[-1].append((1, None) if plus else (0, None) if star else (int(least), int(most)))
        else:
            raise ValueError(f"no amount of words in {mark[0]}")
    if len(open_lists) > 1:
        raise ValueError("an optional region doesn't end")
    return open_lists[0] + words_of(template[at:])


class Automaton:
    """Places of a template: the word each consumes, where a run may begin and end, and what may follow a place."""

    def __init__(self, template: str):
        told = regions(template)
        self.word: list[str | None] = []
        self.follow: list[set[int]] = []
        self.first, self.last, empty = self._sequence(told)
        if empty:
            raise ValueError("a template needs mandatory words")
        runs = "\0".join(x if isinstance(x, str) else "\1" for x in told).split("\1")
        self.anchor = max(([w for w in run.split("\0") if w] for run in runs), key=lambda run: sum(map(len, run)))
        if not self.anchor:
            raise ValueError("a template needs mandatory words")
        self.begins: dict[str, list[int]] = {}
        for place in self.first:
            if self.word[place] is not ANY:
                self.begins.setdefault(self.word[place], []).append(place)
        self.begins_anywhere = [place for place in self.first if self.word[place] is ANY]

    def _place(self, word: str | None) -> int:
        self.word.append(word)
        self.follow.append(set())
        return len(self.word) - 1

    def _sequence(self, told: list) -> tuple[set[int], set[int], bool]:
        """Places where a run of the sequence may begin and end, and whether it may be empty."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for part in told:
            if isinstance(part, str):
                place = self._place(part)
                begin, end, skip = {place}, {place}, False
            elif isinstance(part, list):
                begin, end, _ = self._sequence(part)
                skip = True
            else:
                begin, end, skip = self._words(*part)
            for place in last:
                self.follow[place] |= begin
            first |= begin if empty else set()
            last = last | end if skip else end
            empty = empty and skip
        return first, last, empty

    def _words(self, least: int, most: int | None) -> tuple[set[int], set[int], bool]:
        """Places for ``least`` to ``most`` words of any kind."""
        places = [self._place(ANY) for _ in range(max(least, 1) if most is None else most)]
        for a, b in zip(places, places[1:], strict=False):
            self.follow[a].add(b)
        if most is None:
            self.follow[places[-1]].add(places[-1])
        return set(places[:1]), set(places[max(least, 1) - 1 :]), least == 0

    def accepts(self, words: list[str]) -> bool:
        """Whether the template stands anywhere in the words."""
        now: set[int] = set()
        begins, anywhere, word, follow = self.begins, self.begins_anywhere, self.word, self.follow
        for w in words:
            if not now and not anywhere and w not in begins:
                continue
            after = set(begins.get(w, ()))
            after.update(anywhere)
            for place in now:
                for p in follow[place]:
                    if word[p] is ANY or word[p] == w:
                        after.add(p)
            if after & self.last:
                return True
            now = after
        return False


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: n_words, n_base places of phrases, the first and last of them, base_labels, labels with the templates', and score.

    The score is 1 where a template's whole mandatory wording stands, 0.5 where only a phrase does, else 0.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    for template in templates.values():
        Automaton(template)  # faults of the markup show before any task runs
    ids = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, machine, f" {' '.join(machine.anchor)} ".encode()) for label, machine in ((label, Automaton(t)) for label, t in templates.items())]
        wanted = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().translate(_WORDS).split() if text.is_valid else []
                told = b" ".join([b"", *words, b""]) if words else b""
                places, base = [], set()
                for phrase, label in wanted:
                    at = told.find(phrase)
                    while at >= 0:
                        places.append(told.count(b" ", 0, at))
                        base.add(label)
                        at = told.find(phrase, at + 1)
                found = {label for label, machine, anchor in automata if anchor in told and machine.accepts([w.decode() for w in words])}
                score = 1.0 if found else 0.5 if base else 0.0
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    return id_and_text(docs).mapInArrow(read, f"doc_id {ids}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def template_pattern(template: str) -> str:
    """The template as a regular expression over words joined by single spaces, one space before each; for engines without automata."""

    def told(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, str):
                out += " " + re.escape(part)
            elif isinstance(part, list):
                out += f"({told(part)})?"
            else:
                out += f"( [^ ]+){{{part[0]},{'' if part[1] is None else part[1]}}}"
        return out

    return told(regions(template)) + " "

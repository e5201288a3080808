"""Licence scans by template markup compiled to token automata.

A template is a sequence of words with two kinds of regions:

``[[ ... ]]``     optional: the words inside may stand or be missing as a whole; regions nest.
``{{n}}``         replaceable: up to n words of any kind.
``{{a b|c}}``     replaceable by one of the listed wordings.

Everything else is mandatory and must stand word for word; white space, punctuation and the case of A-Z carry nothing.
All templates form one nondeterministic automaton over words, whose deterministic states are built when a text first needs
them. A text is scanned from every place where some template can begin. Base phrases are templates without regions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from excerpta.llm.common import batches, per_worker

# Base phrases and their labels.
PHRASES = {
    "gpl": ["gnu general public license"],
    "apache": ["apache license"],
    "cc-by": ["cc by"],
    "mit": ["mit license"],
}
# Whole wordings of short public licences. Names of holders are replaceable, numbers of clauses optional.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
    "so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] "
    "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any "
    "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "{{noninfringement|non infringement}} in no event shall {{12}} be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the "
    "software"
)
ISC = (
    "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and "
    "{{12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in "
    "no event shall {{12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
    "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software"
)
BSD_2 = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
    "the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_3 = (
    "[[3]] neither the name of {{12}} nor the names of {{6}} contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission"
)
BSD_END = (
    "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute "
    "goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
    "advised of the possibility of such damage"
)
# Public licence statements and wordings, each with the identifier of its licence.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license [[version]] 2 0",
        "spdx license identifier apache 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0",
    ],
    "gpl-3.0": [
        "{{licensed|released|distributed}} under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[0]]",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {{1}} version 3",
        "spdx license identifier gpl 3 0 [[{{only|or later}}]]",
    ],
    "gpl-2.0": [
        "{{licensed|released|distributed}} under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[0]]",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {{1}} version 2",
        "spdx license identifier gpl 2 0 [[{{only|or later}}]]",
    ],
    "mit": [
        "{{licensed|released|distributed}} under the [[terms of the]] mit license",
        "spdx license identifier mit",
        MIT,
    ],
    "cc-by": ["licensed under [[a]] {{cc by|creative commons attribution}} {{1 0|2 0|2 5|3 0|4 0}} [[international]] [[license]]"],
    "cc-by-nc": ["licensed under [[a]] {{cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial}} {{1 0|2 0|2 5|3 0|4 0}} [[international]] [[license]]"],
    "cc-by-sa": ["licensed under [[a]] {{cc by sa|creative commons attribution sharealike|creative commons attribution share alike}} {{1 0|2 0|2 5|3 0|4 0}} [[international]] [[license]]"],
    "bsd-2-clause": ["spdx license identifier bsd 2 clause", f"{BSD_2} {BSD_END}"],
    "bsd-3-clause": ["spdx license identifier bsd 3 clause", f"{BSD_2} {BSD_3} {BSD_END}"],
    "isc": ["spdx license identifier isc", ISC],
    "mpl-2.0": ["subject to the terms of the mozilla public license [[v]] [[version]] 2 0"],
    "all-rights-reserved": ["[[copyright {{8}}]] all rights reserved"],
}
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TO_WORDS = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SCANNED = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
)


class Automaton:
    """Templates as one automaton over words (as bytes)."""

    def __init__(self, templates: dict[str, list[str]]):
        self.on: list[dict[bytes, set[int]]] = [{}]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.label: dict[int, str] = {}
        for label, wordings in templates.items():
            for wording in wordings:
                end = self._sequence(0, re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+", wording))
                self.label[end] = label
        self.start = self._closure({0})
        self.memo: dict[tuple[frozenset, bytes], frozenset] = {}
        self.first = {w for s in self.start for w in self.on[s]}
        if any(self.any[s] for s in self.start):
            raise ValueError("a template begins with a replaceable region")

    def _state(self) -> int:
        for table in (self.on, self.any, self.free):
            table.append({} if table is self.on else set())
        return len(self.on) - 1

    def _words(self, state: int, words: list[str]) -> int:
        for word in words:
            after = self._state()
            self.on[state].setdefault(word.encode(), set()).add(after)
            state = after
        return state

    def _sequence(self, state: int, parts: list[str]) -> int:
        opened = []
        for part in parts:
            if part == "[[":
                opened.append(state)
                inner = self._state()
                self.free[state].add(inner)
                state = inner
            elif part == "]]":
                after = self._state()
                self.free[state].add(after)
                self.free[opened.pop()].add(after)
                state = after
            elif part.startswith("{{"):
                after, inside = self._state(), part[2:-2]
                if inside.isdigit():
                    for _ in range(int(inside)):
                        self.free[state].add(after)
                        step = self._state()
                        self.any[state].add(step)
                        state = step
                    self.free[state].add(after)
                else:
                    for wording in inside.split("|"):
                        self.free[self._words(state, wording.split())].add(after)
                state = after
            else:
                state = self._words(state, [part])
        end = self._state()  # a state of its own, so that no other template goes on from it
        self.free[state].add(end)
        return end

    def _closure(self, states: set[int]) -> frozenset:
        todo, found = list(states), set(states)
        while todo:
            for state in self.free[todo.pop()] - found:
                found.add(state)
                todo.append(state)
        return frozenset(found)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word)
        after = self.memo.get(key)
        if after is None:
            after = self._closure({t for s in states for t in self.on[s].get(word, ()) or ()} | {t for s in states for t in self.any[s]})
            if any(word in self.on[s] for s in states) or len(self.memo) < 50_000:  # words that match nothing are endless
                self.memo[key] = after
        return after

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last) of the longest match of each label from each place."""
        first, out = self.first, []
        for at in [n for n, w in enumerate(words) if w in first]:
            states, end, best = self.start, at, {}
            while states and end < len(words):
                states = self.step(states, words[end])
                end += 1
                for state in states:
                    if state in self.label:
                        best[self.label[state]] = end
            out += [(label, at, stop) for label, stop in sorted(best.items())]
        return out


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.translate(TO_WORDS).split()


def scan_words(words: list[bytes], base: Automaton, templates: Automaton) -> tuple:
    """The columns of one text; see :func:`license_scan`."""
    places = base.matches(words)
    found = templates.matches(words) if places or any(w in templates.first for w in words) else []
    starts = [start for _, start, _ in places]
    base_labels = sorted({label for label, _, _ in places})
    labels = sorted({label for label, _, _ in found} | set(base_labels))
    covered, upto = 0, 0
    for start, end in sorted((s, e) for _, s, e in places + found):
        covered += max(0, end - max(start, upto))
        upto = max(upto, end)
    matches = [{"label": x, "start": s, "end": e} for x, s, e in found]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(base_labels), ",".join(labels), covered / len(words) if words else 0.0, matches,
    )


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, key="doc_id", text="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word, last_word (least and
    greatest start of these, else null), base_labels, labels (also those of matched templates; distinct, sorted,
    comma-joined), score (share of the words inside a match) and matches (label, start, end in words).

    A licence is named by a statement that names it, or by its whole mandatory wording; an opening sentence followed by
    other terms is not it. A null or wordless text has no places, empty labels and score 0. Where several matches of a label
    begin at a word the longest counts. Repeated rows give equal rows, an empty table none; other columns, whatever their
    names, are ignored.
    """
    name = ("licenses", repr(templates), repr(phrases))

    def run(it):
        base, full = per_worker(name, lambda: (Automaton(phrases), Automaton(templates)))

        def rows():
            for batch in it:
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc, *scan_words(words_of(content.as_buffer().to_pybytes()), base, full)

        return batches(rows(), SCANNED, 1024)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<label:string,start:long,end:long>>",
    )

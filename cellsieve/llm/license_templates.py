"""License scans with template markup.

A template is wording with optional regions, <<beginOptional>> ... <<endOptional>>, and replaceable regions,
<<var;name=...;match=first wording|second wording>> or <<var;name=...;words=least-most>>. It is compiled into an
automaton over words; a text is accepted where the mandatory words stand in order, with nothing between them but what
optional and replaceable regions allow. Automata are started only where the template's anchor stands, its first
mandatory words, which a plain search over the normalised bytes finds.

The base phrases are found by the same search, and their labels stay whatever the templates say. The score is the
largest share of mandatory words that any started automaton consumed in order, 1 where a template or phrase is
accepted, 0 where no anchor stands.

Defined cases: null and empty texts have no words, no labels and score 0; texts of any length are read whole; repeated
ids give a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cellsieve.llm.common import LOWER

# The given phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = (
    ("mit", "<<beginOptional>>this software is<<endOptional>> released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction",
    ),
    ("apache-2", "licensed under the apache license version <<var;name=version;match=2 0|2>>"),
    ("apache-2", "licensed under the terms of the apache license <<beginOptional>>version<<endOptional>> <<var;name=version;match=2 0|2>>"),
    (
        "gpl-3",
        "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<var;name=version;match=3 0|3|v3>>",
    ),
    (
        "lgpl-3",
        "licensed under the gnu lesser general public license <<beginOptional>>version<<endOptional>> <<var;name=version;match=3 0|3|v3>>",
    ),
    (
        "gpl-any",
        "redistribute it and or modify it under the terms of the gnu general public license <<var;name=body;words=0-6>> "
        "published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    (
        "cc-by",
        "licensed under a creative commons attribution <<var;name=version;match=4 0|3 0>> "
        "<<beginOptional>>international<<endOptional>> license",
    ),
    ("cc-by-nc", "licensed under cc by nc <<beginOptional>>sa<<endOptional>> <<var;name=version;match=4 0|3 0>>"),
    ("proprietary", "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;words=1-8>> all rights reserved"),
    # Whole texts, from the first word of the grant to the end of the disclaimer.
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice <<beginOptional>>including the next "
        "paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "<<var;name=holder;words=1-8>> be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with "
        "or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and <<var;name=holder;words=1-8>> disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall "
        "<<var;name=holder;words=1-8>> be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met <<beginOptional>><<var;name=bullet;match=1|a|i>><<endOptional>> redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<beginOptional>><<var;name=bullet;match=2|b|ii>><<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>>"
        "<<beginOptional>><<var;name=bullet;match=3|c|iii>><<endOptional>> neither the name of "
        "<<var;name=holder;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission<<endOptional>> this software is provided by <<var;name=holder;words=1-8>> as is and any express or "
        "implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions",
    ),
    (
        "apache-2-header",
        "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use this file "
        "except in compliance with the license you may obtain a copy of the license at "
        "<<var;name=address;words=3-8>> unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl-header",
        "is free software you can redistribute it and or modify it under the terms of the gnu "
        "<<var;name=kind;match=general|lesser general|affero general>> public license as published by the free software "
        "foundation either version <<var;name=version;words=1-2>> of the license or "
        "<<beginOptional>>at your option<<endOptional>> any later version",
    ),
)
ANCHOR_WORDS = 3

# Everything but 0-9, a-z and non-ASCII bytes ends a word.
NORMAL = bytes(int(LOWER[b]) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """States are numbered; each has word moves, moves on any word, and free moves. `done` counts the mandatory words
    before a state."""

    def __init__(self, template: str) -> None:
        self.moves: list[dict[bytes, set[int]]] = []
        self.any: list[set[int]] = []
        self.free: list[set[int]] = []
        self.done: list[int] = []
        self.mandatory: list[bytes] = []
        self.anchor: tuple[bytes, ...] = ()
        at, opened, leading, anchor = self._state(0), [], True, []
        self.start = at
        for n, part in enumerate(MARK.split(template)):
            if n % 2 == 0:
                for word in words_of(part.encode()):
                    at = self._word(at, word, not opened)
                    if not opened and leading:
                        anchor.append(word)
            elif part == "beginOptional":
                leading = leading and not anchor
                opened.append(at)
            elif part == "endOptional":
                begin, end = opened.pop(), self._state(self.done[at])
                self.free[at].add(end)
                self.free[begin].add(end)
                at = end
                if not opened and not anchor:
                    self.start = at  # what stands before the anchor is optional: it need not be read
            else:
                leading = leading and not anchor
                at = self._variable(at, dict(f.partition("=")[::2] for f in part.split(";")[1:]))
        self.anchor = tuple(anchor[:ANCHOR_WORDS])
        self.accept = at

    def _state(self, done: int) -> int:
        self.moves.append({})
        self.any.append(set())
        self.free.append(set())
        self.done.append(done)
        return len(self.moves) - 1

    def _word(self, at: int, word: bytes, counts: bool) -> int:
        end = self._state(self.done[at] + counts)
        self.moves[at].setdefault(word, set()).add(end)
        if counts:
            self.mandatory.append(word)
        return end

    def _variable(self, at: int, rule: dict[str, str]) -> int:
        end = self._state(self.done[at])
        if "match" in rule:
            for wording in rule["match"].split("|"):
                here = at
                for word in words_of(wording.encode()):
                    here = self._word(here, word, False)
                self.free[here].add(end)
        else:
            least, most = map(int, rule["words"].split("-"))
            for n in range(most + 1):
                if n >= least:
                    self.free[at].add(end)
                if n < most:
                    following = self._state(self.done[at])
                    self.any[at].add(following)
                    at = following
        return end

    def _closed(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - found:
                found.add(s)
                todo.append(s)
        return found

    def run(self, words: list[bytes], at: int) -> tuple[bool, float]:
        """Whether the template is accepted from word `at` on, and the share of mandatory words read."""
        states, most = self._closed({self.start}), 0
        while True:
            most = max([most, *(self.done[s] for s in states)])
            if self.accept in states:
                return True, 1.0
            if at >= len(words) or not states:
                return False, most / len(self.mandatory)
            following = set()
            for s in states:
                following |= self.moves[s].get(words[at], set()) | self.any[s]
            states, at = self._closed(following), at + 1


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words where a phrase begins, in words joined by single spaces with a space at both ends; overlaps
    included. Words are counted on from place to place, so a text is walked through once."""
    needle, word, counted = b" " + phrase + b" ", 0, 0
    at = joined.find(needle)
    while at >= 0:
        word, counted = word + joined.count(b" ", counted, at), at
        yield word
        at = joined.find(needle, at + 1)


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.phrases = [(p.encode(), label) for p, label in phrases.items()]
        self.by_anchor: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, template in templates:
            automaton = Automaton(template)
            self.by_anchor.setdefault(b" ".join(automaton.anchor), []).append((label, automaton))

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base, hits = set(), []
        for phrase, label in self.phrases:
            found = list(places(joined, phrase))
            if found:
                base.add(label)
                hits += (found[0], found[-1], len(found))
        labels, score = set(base), float(bool(base))
        for anchor, automata in self.by_anchor.items():
            for first in places(joined, anchor):
                for label, automaton in automata:
                    accepted, share = automaton.run(words, first)
                    if accepted:
                        labels.add(label)
                    score = max(score, share)
        n_base = sum(hits[2::3])
        first, last = (min(hits[0::3]), max(hits[1::3])) if hits else (None, None)
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            rows = [scanner.scan(t.as_py() or b"") for t in texts]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, *names]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(job, f"`{id_col}` {kind}, {FIELDS}")

"""License scans by template-markup matching.

A template is a license's wording with markup: [[ ... ]] may be missing, {{n}} stands for any one
to n words. It compiles to an automaton over word tokens. Every word outside the markup is
mandatory and must match exactly; a text is accepted where an automaton reaches its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, id_and_text

#: Phrases whose places are the base result, with their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: What licenses end with, about the software as it is (fixed values: the licenses' public wording).
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {{6}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_GNU_END = (
    "[[this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details [[you should have received a copy of the gnu general public license along with this program]]]]"
)
#: License texts and notices as templates, by label (fixed values: the licenses' public wording, whole).
TEMPLATES = {
    "mit": (
        "[[released]] under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _NO_WARRANTY,
    ),
    "apache-2": (
        "licensed under the apache license version 2 [[0]]",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{1}} www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "cc-by-nc": ("licensed under cc by nc [[4 0]]", "creative commons attribution non commercial [[{{1}} 0]] [[international]] license", "creative commons attribution noncommercial [[{{1}} 0]] [[international]] license"),
    "cc-by": ("licensed under cc by {{1}} 0", "creative commons attribution {{1}} 0 [[international]] license"),
    "cc-by-sa": ("licensed under cc by sa [[{{1}} 0]]", "creative commons attribution sharealike [[{{1}} 0]] [[international]] license"),
    "gpl-3": (
        "licensed under the gnu general public license version 3 [[0]] [[or later]]",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version " + _GNU_END,
        "under the terms of the gnu general public license version 3",
    ),
    "gpl-2": (
        "licensed under the gnu general public license version 2 [[0]] [[or later]]",
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version " + _GNU_END,
    ),
    "lgpl": ("licensed under the gnu lesser general public license [[version {{1}} [[{{1}}]]]]",),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{1}} mozilla org mpl 2 0",
        "licensed under the mozilla public license version 2 [[0]]",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[[[3]] neither the name of {{8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
        "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "[[released]] under the bsd [[{{1}} clause]] license",
    ),
    "isc": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "[[released]] under the isc license",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
        + _NO_WARRANTY,
    ),
}

#: Words: runs of anything but ASCII characters other than 0-9 and a-z, after A-Z became a-z. Bytes from 0x80 on are parts of words.
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def compile_template(template: str) -> tuple[list[dict[bytes, set[int]]], list[set[int]], set[int]]:
    """(moves by word, moves by any word, final states) of a template; state 0 is the start.

    Built from right to left: an element's states lead to those of what follows, and what may be
    missing also lets through to it.
    """
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template)
    moves: list[dict[bytes, set[int]]] = []
    free: list[set[int]] = []
    skip: list[set[int]] = []  # moves without a word

    def state() -> int:
        moves.append({})
        free.append(set())
        skip.append(set())
        return len(moves) - 1

    at, opened = state(), []
    for part in parts:
        if part == "[[":
            opened.append(at)
        elif part == "]]":
            skip[opened.pop()].add(at)
        elif part.startswith("{{"):
            stop = state()
            for k in range(n := int(part[2:-2])):
                free[at].add(stop)
                if k < n - 1:
                    step = state()
                    free[at].add(step)
                    at = step
            at = stop
        else:
            to = state()
            moves[at].setdefault(part.encode(), set()).add(to)
            at = to
    if opened:
        raise ValueError(f"[[ without ]] in {template!r}")
    reach = []
    for s in range(len(moves)):
        seen, todo = {s}, [s]
        while todo:
            new = skip[todo.pop()] - seen
            seen |= new
            todo += new
        reach.append(seen)
    final = {s for s in range(len(moves)) if at in reach[s]}
    closed_moves = [{} for _ in moves]
    closed_free: list[set[int]] = [set() for _ in moves]
    for s, seen in enumerate(reach):
        for t in seen:
            closed_free[s] |= free[t]
            for w, to in moves[t].items():
                closed_moves[s].setdefault(w, set()).update(to)
    return closed_moves, closed_free, final


class Scanner:
    """All templates' automata. A scan starts only at words that can begin a template."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.automata, self.starts = [], {}
        for label, wordings in templates.items():
            for wording in wordings:
                moves, free, final = compile_template(wording)
                if free[0] or 0 in final:
                    raise ValueError(f"a template begins with a mandatory or an optional word: {wording!r}")
                plain = re.sub(r"\[\[.*\]\]|\{\{\d+\}\}", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", wording)).split()
                number = len(self.automata)
                self.automata.append((label, moves, free, final, max(plain, key=len).encode()))
                for w in moves[0]:
                    self.starts.setdefault(w, []).append(number)

    def scan(self, words: list[bytes], there: set[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label) for each place where a template's longest reading ends; `there`: the words as a set."""
        open_ = {w: [k for k in ks if self.automata[k][4] in there] for w, ks in self.starts.items() if w in there}
        open_ = {w: ks for w, ks in open_.items() if ks}
        if not open_:
            return []
        found = []
        for i, w in enumerate(words):
            for k in open_.get(w, ()):
                label, moves, free, final, _ = self.automata[k]
                states, end, j = {0}, 0, i
                while states and j < len(words):
                    states = {t for s in states for t in (*moves[s].get(words[j], ()), *free[s])}
                    j += 1
                    if states & final:
                        end = j
                if end:
                    found.append((i, end, label))
        return found


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                out.append(at)
    except ValueError:
        return out


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<first:long,last:long,label:string>>"


def _scan(templates: dict[str, tuple[str, ...]], phrases: tuple):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        base = [(p.encode().split(), label) for p, label in phrases]
        for b in parts:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                there = set(words)
                starts, labels = [], set()
                for phrase, label in base:
                    if there.issuperset(phrase) and (at := _places(words, phrase)):
                        starts += at
                        labels.add(label)
                found = scanner.scan(words, there)
                covered, end = 0, 0
                for i, j, _ in sorted(found):
                    covered += max(0, j - max(i, end))
                    end = max(end, j)
                every = labels | {x[2] for x in found}
                # The share of the text's words that accepted wording covers, at least 0.5 where there is a license at all.
                score = 0.5 + 0.5 * covered / len(words) if every else 0.0
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, [{"first": i, "last": j, "label": x} for i, j, x in found]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            place = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), place]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, phrases: tuple = PHRASES) -> DataFrame:
    """One row per row of docs (columns doc_id, text); see SCANNED for the columns.

    A-Z counts as a-z; words are runs of ASCII letters and digits and all other characters from
    U+0080 on. n_base, first_word and last_word concern the base phrases' places only; places
    lists the templates' accepted wording, last exclusive. A null or empty text has no words, no
    labels and score 0. Repeated rows give equal rows. An empty table gives none.
    """
    return id_and_text(docs).mapInArrow(_scan(TEMPLATES if templates is None else templates, phrases), SCANNED)

"""Licence scans: matching statistics against a generalised suffix automaton.

The tokens of all licence templates and phrases go into one suffix automaton. A text is
streamed through it once; after every word the automaton holds the longest run of words
ending there that stands in some template. Runs that cannot be made longer are anchors;
anchors that follow each other in a text and in a template are chained, and a chain that
covers enough of its template is a span. Phrases are told from the same states: a phrase
ends where its state lies on the suffix links of the current one.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import appended, kept_in_worker, plain_words

#: Phrases of the contract with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Public licence notices with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
               "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
               "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
             "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
]

_SPAN = "array<struct<label:string,template:int,first_word:bigint,last_word:bigint,covered:bigint,share:double>>"


class SuffixAutomaton:
    """All runs of tokens of several sequences. State 0 is the empty run.

    ``ends[state]`` are the (sequence, end) places at which the runs of a state end, kept
    for states of at least ``least`` tokens; their number is bounded by the templates.
    """

    def __init__(self, sequences: Sequence[Sequence[bytes]], least: int):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extended(last, token)
                while len(ends) < len(self.step):
                    ends.append(set())
                ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= least:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) if n >= least else [] for e, n in zip(ends, self.length)]

    def _state(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _split(self, parent: int, token: bytes) -> int:
        """The state of exactly ``parent`` and ``token``, cut out of a longer one if need be."""
        child = self.step[parent][token]
        if self.length[child] == self.length[parent] + 1:
            return child
        own = self._state(self.length[parent] + 1, self.link[child], dict(self.step[child]))
        self.link[child] = own
        while parent >= 0 and self.step[parent].get(token) == child:
            self.step[parent][token] = own
            parent = self.link[parent]
        return own

    def _extended(self, last: int, token: bytes) -> int:
        if token in self.step[last]:  # another sequence went this way
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and token not in self.step[last]:
            self.step[last][token] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, token)
        return new

    def statistics(self, words: Iterable[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest run ending at each place, where there is one."""
        step, link, length = self.step, self.link, self.length
        first, state, size = step[0], 0, 0
        for place, word in enumerate(words):
            if not state and word not in first:
                continue
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            state = step[state].get(word, 0)
            size = size + 1 if state else 0
            if state:
                yield place, state, size


@dataclass(frozen=True)
class Anchor:
    """Words ``first`` to ``end`` (without) of a text are words from ``at`` on of a template."""

    template: int
    first: int
    end: int
    at: int


class Scanner:
    """Finds phrases and covered templates in words."""

    def __init__(self, templates, phrases, least: int, share: float, gap: int):
        self.labels = [label for label, _ in templates]
        self.sizes = [len(plain_words(text)) for _, text in templates]
        self.phrases = [(label, len(plain_words(text))) for text, label in phrases]
        self.least, self.share, self.gap = least, share, gap
        tokens = [plain_words(text) for _, text in templates] + [plain_words(text) for text, _ in phrases]
        self.automaton = SuffixAutomaton(tokens, least)
        of_state: dict[int, list[int]] = defaultdict(list)
        for number, words in enumerate(tokens[len(templates) :]):
            state = 0
            for word in words:
                state = self.automaton.step[state][word]
            if words:
                of_state[state].append(number)
        #: For every state, the phrases on its suffix links; its own last ones need their length.
        self.told: list[list[int]] = [[] for _ in self.automaton.step]
        for state in sorted(range(1, len(self.told)), key=lambda s: self.automaton.length[s]):
            self.told[state] = self.told[self.automaton.link[state]] + of_state.get(state, [])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[dict]]:
        """Places of phrases (first word, label) and spans of templates."""
        places: list[tuple[int, str]] = []
        anchors: list[Anchor] = []
        held = (-2, 0, 0)

        def close() -> None:
            place, state, size = held
            if size >= self.least:
                for template, end in self.automaton.ends[state]:
                    if template < len(self.labels):
                        anchors.append(Anchor(template, place + 1 - size, place + 1, end - size))

        for place, state, size in self.automaton.statistics(words):
            if place != held[0] + 1 or size != held[2] + 1:
                close()
            held = (place, state, size)
            for number in self.told[state]:
                label, length = self.phrases[number]
                if size >= length:
                    places.append((place + 1 - length, label))
        close()
        return places, self.spans(anchors)

    def spans(self, anchors: list[Anchor]) -> list[dict]:
        """Best chains of each template that do not share words, if they cover enough of it.

        An anchor continues a chain that ended at most ``gap`` words before, in the text
        and behind it in the template; words met twice count once.
        """
        found = []
        by_template: dict[int, list[Anchor]] = defaultdict(list)
        for anchor in anchors:
            by_template[anchor.template].append(anchor)
        for template, own in sorted(by_template.items()):
            own.sort(key=lambda a: (a.first, a.at))
            chains: list[tuple[int, int, int, int]] = []  # covered, first word, end, end in the template
            open_: list[int] = []
            for a in own:
                open_ = [c for c in open_ if chains[c][2] + self.gap >= a.first]
                best = (a.end - a.first, a.first)
                for c in open_:
                    covered, first, end, reached = chains[c]
                    cut = max(0, end - a.first, reached - a.at)
                    if a.end > end and cut < a.end - a.first and covered + a.end - a.first - cut > best[0]:
                        best = (covered + a.end - a.first - cut, first)
                open_.append(len(chains))
                chains.append((*best, a.end, a.at + a.end - a.first))
            taken: list[tuple[int, int]] = []
            for covered, first, end, _ in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
                if covered < self.share * self.sizes[template]:
                    break
                place = bisect(taken, (first, end))
                if (not place or taken[place - 1][1] <= first) and (place == len(taken) or taken[place][0] >= end):
                    taken.insert(place, (first, end))
                    found.append(
                        {
                            "label": self.labels[template], "template": template, "first_word": first, "last_word": end - 1,
                            "covered": covered, "share": covered / self.sizes[template],
                        }
                    )
        return sorted(found, key=lambda s: (s["first_word"], s["template"]))


def with_licences(
    frame: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: int = 4, share: float = 0.8, gap: int = 8, column: str = "text"
) -> DataFrame:
    """``frame`` with n_words, phrases (first_word, label) and spans of templates in the whole text.

    ``templates`` are (label, text), ``phrases`` (text, label). Anchors have at least
    ``least`` words; a span covers at least ``share`` of its template. Null texts count
    as empty, texts without words have no phrase or span, repeated rows are each
    answered, other columns stay; columns of the new names are replaced. Nothing but
    the templates is shipped to tasks, and a task holds one slice of texts.
    """
    templates, phrases = [tuple(t) for t in templates], [tuple(p) for p in phrases]
    place = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(
        pa.struct([
            ("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("covered", pa.int64()), ("share", pa.float64()),
        ])
    )
    key = ("licences", tuple(templates), tuple(phrases), least, share, gap)

    def make(texts: list[str]) -> list[pa.Array]:
        scanner = kept_in_worker(key, lambda: Scanner(templates, phrases, least, share, gap))
        sizes, places, spans = [], [], []
        for text in texts:
            words = plain_words(text)
            told, covered = scanner.scan(words)
            sizes.append(len(words))
            places.append([{"first_word": first, "label": label} for first, label in told])
            spans.append(covered)
        return [pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span)]

    return appended(frame, f"n_words bigint, phrases array<struct<first_word:bigint,label:string>>, spans {_SPAN}", make, column)


def licence_digests(frame: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``score`` is 1 where a phrase stands, otherwise the largest share of a template that
    a span covers, 0 without one.
    """
    rows = with_licences(frame.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own = F.col("phrases.label"), F.col("spans.label")
    return rows.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first_word").alias("first_word"), F.array_max("phrases.first_word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )

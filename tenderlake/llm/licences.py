"""Licence terms in report texts: matching statistics on a suffix automaton of licence words."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAST_MATCH = 5
MOST_GAP = 12
LEAST_COVER = 0.6

# Phrases whose every place counts, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public licence notices, with their labels.
NOTICES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl-3",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "mpl-2",
    ),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of ``text`` with A-Z lower-cased, as UTF-8."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Automaton:
    """Generalised suffix automaton of templates: every run of template words is a path from state 0."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    whole: list[list[int]] = field(default_factory=lambda: [[]])
    sizes: list[int] = field(default_factory=list)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        self.whole.append([])
        return len(self.step) - 1

    def _clone(self, state: int, parent: int, word: int) -> int:
        copy = self._state(self.length[parent] + 1, dict(self.step[state]), self.link[state])
        self.link[state] = copy
        while parent >= 0 and self.step[parent].get(word) == state:
            self.step[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        there = self.step[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(there, last, word)
        new, parent = self._state(self.length[last] + 1, {}, 0), last
        while parent >= 0 and word not in self.step[parent]:
            self.step[parent][word] = new
            parent = self.link[parent]
        if parent >= 0:
            there = self.step[parent][word]
            self.link[new] = there if self.length[there] == self.length[parent] + 1 else self._clone(there, parent, word)
        return new

    def add(self, words: Sequence[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
        self.sizes.append(len(words))

    def close(self, templates: Sequence[Sequence[bytes]]) -> Automaton:
        """Note at each state where its word runs end, and which templates are whole there."""
        for number, words in enumerate(templates):
            state = 0
            for at, word in enumerate(words, 1):
                state = self.step[state][self.vocabulary[word]]
                self.places[state].append((number, at))
            self.whole[state].append(number)
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]].extend(self.places[state])
        for state in sorted(range(1, len(self.step)), key=lambda s: self.length[s]):
            self.places[state] = sorted(set(self.places[state]))
            # longer states end with the shorter ones they link to
            self.whole[state] = self.whole[state] + (self.whole[self.link[state]] if self.link[state] > 0 else [])
        return self


def build_automaton(templates: Sequence[tuple[str, str]]) -> Automaton:
    words, built = [words_of(text) for text, _ in templates], Automaton()
    for each in words:
        built.add(each)
    return built.close(words)


def matches(words: Sequence[bytes], automaton: Automaton, phrases: int, least: int = LEAST_MATCH) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Phrase places ``(start, template)`` and maximal long matches ``(start, end, state)`` of one text.

    Walks the words once. The matching statistic at a word is the longest run of
    template words that ends there; templates below ``phrases`` count as phrases
    wherever they are whole, a long match is reported where it can't go on.
    """
    step, link, length, whole, sizes = automaton.step, automaton.link, automaton.length, automaton.whole, automaton.sizes
    found: list[tuple[int, int]] = []
    long: list[tuple[int, int, int]] = []
    state = run = 0
    for at, word in enumerate(map(automaton.vocabulary.get, words)):
        if word is None:
            if run >= least:
                long.append((at - run, at, state))
            state = run = 0
            continue
        if word not in step[state]:
            if run >= least:
                long.append((at - run, at, state))
            while state and word not in step[state]:
                state = link[state]
                run = length[state]
        if word in step[state]:
            state = step[state][word]
            run += 1
        for template in whole[state]:
            if template < phrases and sizes[template] <= run:
                found.append((at - sizes[template] + 1, template))
    if run >= least:
        long.append((len(words) - run, len(words), state))
    return found, long


def chain(long: Sequence[tuple[int, int, int]], automaton: Automaton, first: int, gap: int = MOST_GAP, cover: float = LEAST_COVER) -> list[tuple[int, int, int, float]]:
    """Spans ``(template, start, end, covered share)`` of chained long matches.

    Matches of a template chain if they follow each other in text and template
    with at most ``gap`` words between; a chain that covers at least ``cover`` of
    the template is a span. Spans of one template do not overlap; the fullest goes first.
    """
    spans: list[tuple[int, int, int, float]] = []
    by_template: dict[int, list[tuple[int, int, int, int]]] = {}
    for start, end, state in long:
        for template, stop in automaton.places[state]:
            if template >= first:
                by_template.setdefault(template, []).append((start, end, stop - (end - start), stop))
    for template, pieces in by_template.items():
        pieces.sort()
        best: list[tuple[int, int]] = []
        low = 0
        for i, (start, end, t_start, t_end) in enumerate(pieces):
            value, origin = end - start, start
            while pieces[low][0] < start - gap - automaton.sizes[template]:
                low += 1
            for j in range(low, i):
                _, end2, _, t_end2 = pieces[j]
                if end2 <= start <= end2 + gap and t_end2 <= t_start <= t_end2 + gap and best[j][0] + end - start > value:
                    value, origin = best[j][0] + end - start, best[j][1]
            best.append((value, origin))
        size, taken = automaton.sizes[template], []
        for (value, origin), (_, end, _, _) in sorted(zip(best, pieces), key=lambda x: (-x[0][0], x[0][1], x[1])):
            if value >= cover * size and all(end <= a or origin >= b for a, b in taken):
                taken.append((origin, end))
                spans.append((template, origin, end, min(1.0, value / size)))
    return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, stop: long, covered: double>>"
)


def scan_licences(reports: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """Licence terms of every whole report, one row per input row.

    Columns: ``procurement_id``, ``n_words``, ``n_base`` (all places of all
    phrases), ``first_word`` and ``last_word`` (their smallest and largest start;
    null without any), ``base_labels`` and ``labels`` (those of the phrases, and
    these with those of the spans: distinct, sorted, comma-joined), ``score`` (1
    with a phrase, else the largest covered share of a span, else 0) and
    ``spans``. A null text is empty. One pass, no shuffle; the automaton is built
    once and travels with the job.
    """
    kept = reports.select("procurement_id", "report_text")
    automaton = reports.sparkSession.sparkContext.broadcast(build_automaton([*phrases, *notices]))
    labels, n = [label for _, label in [*phrases, *notices]], len(phrases)
    row = T._parse_datatype_string(SCHEMA)
    schema = T.StructType([T.StructField("procurement_id", kept.schema["procurement_id"].dataType), *row.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton.value
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found, long = matches(words, known, n)
                spans = chain(long, known, n) if long else []
                base = {labels[t] for _, t in found}
                every = base | {labels[s[0]] for s in spans}
                starts = [s for s, _ in found]
                score = 1.0 if found else max((s[3] for s in spans), default=0.0)
                detail = [{"label": labels[t], "start": a, "stop": b, "covered": c} for t, a, b, c in spans]
                out.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score, detail))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())]))]
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=schema.names)

    return kept.mapInArrow(scan, schema)

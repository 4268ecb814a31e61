"""Licence scan: templates with optional and replaceable regions as token automata over the whole text.

A template is a licence's wording with markup: `<<beginOptional>> ... <<endOptional>>` may be absent (regions nest), and
`<<var;match="...">>` stands for other words: `match` is `.{a,b}` for a to b words of any kind, or alternatives `one|or another`. Everything
else is mandatory and must stand word by word, as the word list of a text is made: A-Z lower-cased, runs of letters, digits and characters
outside ASCII. All templates are compiled into one automaton over words; sets of its states are made once as they are met. It is started
wherever two words follow each other that can begin a template, so a text is read once by array steps and only there word by word.

Defined results: a null or empty text has no words and no labels, score 0; very long texts are read in parts whose words are joined again;
repeated rows and ids are scanned each for itself; ties cannot occur, as all matches count; an empty table gives no rows; columns that are
kept pass through untouched, and the result is one struct whose name the caller may choose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches
from tidemark.llm.words import distinct, fold, in_parts

#: Everything in ASCII that is no letter or digit.
BLANKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))

# Phrases that name a licence by themselves, and the public wording of licences and their notices.
PHRASES: tuple[tuple[str, str], ...] = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_BY = '<<var;match="released|licensed|distributed|available|provided|published|offered">>'
_WHO, _ITEM = '<<var;match=".{1,40}">>', '<<beginOptional>><<var;match=".{1,1}">><<endOptional>>'
_BSD_START = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{_ITEM} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{_ITEM} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_END = f"""THIS SOFTWARE IS PROVIDED BY {_WHO} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", f"{_BY} under <<beginOptional>>the terms of<<endOptional>> the MIT License"),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "licensed under <<beginOptional>>the terms of<<endOptional>> the Apache License, Version 2<<beginOptional>>.0<<endOptional>>"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at <<beginOptional>>http<<beginOptional>>s<<endOptional>>://<<endOptional>><<beginOptional>>www.<<endOptional>>apache.org/licenses/LICENSE-2.0
<<beginOptional>>.txt<<endOptional>><<beginOptional>>.html<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("cc-by-nc", f"{_BY} under <<beginOptional>>a<<endOptional>> CC BY-NC <<var;match=\"1 0|2 0|2 5|3 0|4 0\">>"),
    ("cc-by-nc", f"{_BY} under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons Attribution-NonCommercial <<var;match=\"1 0|2 0|2 5|3 0|4 0\">> <<var;match=\"international|unported|generic\">> License"),
    ("cc-by", f"{_BY} under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons Attribution <<var;match=\"1 0|2 0|2 5|3 0|4 0\">> <<var;match=\"international|unported|generic\">> License"),
    ("gpl-3", f"{_BY} under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License, version 3"),
    ("gpl-2", f"{_BY} under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License, version 2"),
    ("gpl-3", """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version"""),
    ("gpl-2", """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version"""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at <<beginOptional>>http<<beginOptional>>s<<endOptional>>://<<endOptional>> mozilla.org/MPL/2.0/"""),
    ("isc", f"""Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {_WHO} DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3", f"""{_BSD_START} {_ITEM} Neither the name of {_WHO} nor the names of {_WHO} may be used to endorse or promote products derived from this software
without specific prior written permission. {_BSD_END}"""),
    ("zlib", f"""This software is provided 'as-is', without any express or implied warranty. In no event will {_WHO} be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: {_ITEM} The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required. {_ITEM} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. {_ITEM} This notice
may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)

MARK = re.compile(r'<<beginOptional>>|<<endOptional>>|<<var;match="([^"]*)">>')
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A parsed template: a word, ("any", a, b), ("or", [words, ...]) or ("maybe", parsed template), one after the other.
Item = str | tuple


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(template: str) -> list[Item]:
    stack: list[list[Item]] = [[]]
    at = 0
    for m in MARK.finditer(template):
        stack[-1] += words_of(template[at : m.start()])
        at = m.end()
        if m[0] == "<<beginOptional>>":
            stack.append([])
        elif m[0] == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            part = stack.pop()
            stack[-1].append(("maybe", part))
        elif span := re.fullmatch(r"\.\{(\d+),(\d+)\}", m[1]):
            stack[-1].append(("any", int(span[1]), int(span[2])))
        else:
            stack[-1].append(("or", [words_of(x) for x in m[1].split("|")]))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0] + words_of(template[at:])


class Automaton:
    """All templates at once. A step is by word number: those of the templates' own words from 1 (`vocabulary`), 0 for any other word."""

    ANY = -1

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in templates]
        self.vocabulary: dict[str, int] = {}
        self.moves: list[list[tuple[int, int]]] = []  # of each state: (word number or ANY, next state)
        self.skips: list[list[int]] = []
        self.ends: dict[int, int] = {}
        start = self._state()
        for k, (_, template) in enumerate(templates):
            parsed = parse(template)
            first = self._state()
            self.skips[start].append(first)
            end = self._chain(parsed, first)
            if end == first or first in self._closure({end}) or end in self._closure({first}):
                raise ValueError(f"template {k} has no mandatory wording")
            self.ends[end] = k
        self._sets: dict[frozenset[int], int] = {}
        self._states: list[frozenset[int]] = []
        self.accepted: list[list[int]] = []  # of each set of states: the templates that end there
        self.steps: list[dict[int, int]] = []
        self.dead = self._set(frozenset())
        self.start = self._set(frozenset(self._closure({start})))

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _chain(self, items: list[Item], at: int) -> int:
        """Append items behind a state; gives the state after them."""
        for item in items:
            if isinstance(item, str):
                at = self._step(at, self.vocabulary.setdefault(item, len(self.vocabulary) + 1))
            elif item[0] == "any":
                for k in range(item[2]):
                    after = self._step(at, self.ANY)
                    if k >= item[1]:
                        self.skips[at].append(after)
                    at = after
            elif item[0] == "or":
                ends = [self._chain(words, at) for words in item[1]]
                at = self._state()
                for e in ends:
                    self.skips[e].append(at)
            else:
                after = self._chain(item[1], at)
                before, at = at, self._state()
                self.skips[before].append(at)
                self.skips[after].append(at)
        return at

    def _step(self, at: int, word: int) -> int:
        after = self._state()
        self.moves[at].append((word, after))
        return after

    def _closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def _set(self, states: frozenset[int]) -> int:
        if states not in self._sets:
            self._sets[states] = len(self._states)
            self._states.append(states)
            self.accepted.append(sorted(self.ends[s] for s in states if s in self.ends))
            self.steps.append({})
        return self._sets[states]

    def step(self, at: int, word: int) -> int:
        found = self.steps[at].get(word)
        if found is None:
            after = {t for s in self._states[at] for w, t in self.moves[s] if w == self.ANY or w == word and word}
            found = self.steps[at][word] = self._set(frozenset(self._closure(after)))
        return found

    def beginnings(self) -> np.ndarray:
        """[a, b]: the words numbered a and b may begin a template. One that may end after its first word begins with any b."""
        n = len(self.vocabulary) + 1
        out = np.zeros((n, n), bool)
        for a in range(n):
            one = self.step(self.start, a)
            if one != self.dead:
                out[a] = [bool(self.accepted[one]) or self.step(one, b) != self.dead for b in range(n)]
        return out

    def run(self, words: np.ndarray, first: int) -> list[tuple[int, int]]:
        """(template, one after its last word) of all that is accepted from this word on."""
        at, out, k = self.start, [], first
        while at != self.dead and k < len(words):
            at = self.step(at, int(words[k]))
            k += 1
            out += [(t, k) for t in self.accepted[at]]
        return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.automaton, self.phrases = Automaton(templates), []
        numbers = self.automaton.vocabulary
        for phrase, label in phrases:
            self.phrases.append((np.array([numbers.setdefault(w, len(numbers) + 1) for w in phrase.split()]), label))
        self.numbers = {w.encode(): k for w, k in numbers.items()}
        self.begin = self.automaton.beginnings()
        self.table = fold(BLANKS)

    def word_numbers(self, parts: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, words up to each row's end). parts: the rows' texts, or parts of one row's text."""
        numbers, counts = [], []
        for part in parts:
            codes, names, ends = distinct(part, self.table)
            known = np.array([-1 if not w else self.numbers.get(w, 0) for w in names] or [0], "i2")[codes] if len(codes) else np.zeros(0, "i2")
            real = known >= 0  # blanks alone are no word
            numbers.append(known[real])
            counts.append(np.append(0, np.cumsum(real))[ends])
        ends = counts[0] if len(parts) == 1 and rows == len(counts[0]) else np.array([sum(int(c[-1]) for c in counts)])
        return np.concatenate(numbers), ends

    def scan(self, texts: pa.Array) -> Iterator[tuple]:
        """Of each text: words, places of phrases, first and last of them, their labels, matches (label, first word, words)."""
        for lo, hi, parts in in_parts(texts, BLANKS):
            words, ends = self.word_numbers(parts, hi - lo)
            starts = np.append(0, ends[:-1])
            doc = np.repeat(np.arange(hi - lo), ends - starts)
            hits = [(int(k), int(doc[k]), label) for pattern, label in self.phrases for k in self._places(words, doc, pattern).tolist()]
            places: dict[int, list[tuple[int, str]]] = {}
            for k, d, label in hits:
                places.setdefault(d, []).append((k - int(starts[d]), label))
            matches: dict[int, list[tuple[str, int, int]]] = {}
            after = np.append(words[1:], 0)[: len(words)] if len(words) else words
            after = np.where(np.append(doc[1:] == doc[:-1], False) if len(words) else [], after, 0)
            for k in np.nonzero(self.begin[words, after])[0].tolist():
                d = int(doc[k])
                for t, end in self.automaton.run(words[k : ends[d]], 0):
                    matches.setdefault(d, []).append((self.automaton.labels[t], k - int(starts[d]), end))
            for d in range(hi - lo):
                found = sorted(places.get(d, []))
                yield int(ends[d] - starts[d]), len(found), found[0][0] if found else None, found[-1][0] if found else None, sorted({x for _, x in found}), matches.get(d, [])

    def _places(self, words: np.ndarray, doc: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        n = len(words) - len(pattern) + 1
        if n <= 0:
            return np.zeros(0, "i8")
        hit = doc[:n] == doc[len(pattern) - 1 :]
        for j, w in enumerate(pattern):
            hit &= words[j : j + n] == w
        return np.nonzero(hit)[0]


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))),
])
_SCANNERS: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", into: str = "license", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """The kept columns and a struct `into` with the words, the phrases' places and the templates' matches of each text."""
    if into in keep:
        raise ValueError(f"{into} is the name of a kept column; choose another for the result")
    Automaton(templates)  # faulty markup is told here, not by a task
    text = next(f"text{k}" for k in range(len(keep) + 1) if f"text{k}" not in keep)
    given = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (templates, phrases)
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(templates, phrases)
        for batch in batches:
            rows = list(_SCANNERS[key].scan(batch.column(text).cast(pa.binary())))
            names = [f.name for f in _ARROW]
            found = pa.array([dict(zip(names, r[:5] + ([dict(zip(("label", "first", "words"), m)) for m in r[5]],))) for r in rows], _ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, into])

    return map_batches(given, run, T.StructType([*given.select(*keep).schema.fields, T.StructField(into, RESULT)]))


def labels(found) -> F.Column:
    """Distinct labels of a result, by phrases or templates, in order."""
    return F.array_sort(F.array_union(found.base_labels, F.transform(found.matches, lambda m: m.label)))


def score(found) -> F.Column:
    """0 without a label; else the mean over the labels of 1 where a template's whole mandatory wording was matched and one half where only a phrase stands."""
    every, sure = labels(found), F.array_distinct(F.transform(found.matches, lambda m: m.label))
    return F.when(F.size(every) > 0, (F.size(every) + F.size(sure)) / (2 * F.size(every))).otherwise(F.lit(0.0))


def regex(items: list[Item]) -> str:
    """The same template over words that each end with a space, for engines without automata of our own."""
    out = ""
    for item in items:
        if isinstance(item, str):
            out += item + " "
        elif item[0] == "any":
            out += f"(?:[^ ]+ ){{{item[1]},{item[2]}}}"
        elif item[0] == "or":
            out += "(?:" + "|".join("".join(w + " " for w in words) for words in item[1]) + ")"
        else:
            out += f"(?:{regex(item[1])})?"
    return out
